r"""Secret scans: fixed patterns, and a battery of randomness tests on long tokens.

Patterns give the base spans (assign, access, hex).  Every other token of 20
characters or more whose encoding can be inferred (hex, base32, letters of one case
with digits, base64, URL-safe base64) is tested:

* chi-squared uniformity over the encoding's alphabet and over its classes (upper
  case, lower case, digits, signs), runs above and below the middle of the
  alphabet, and serial correlation of neighbours.  A token that any of them finds
  non-random is dropped (each at a quarter of ``BATTERY``);
* how much likelier a uniform key is than ordinary text, whose letters have
  uneven shares and whose classes of characters seldom change.  Under that null
  hypothesis a likelihood ratio of r or more has at most the probability 1 / r, at
  any length.  A twentieth of the rate goes to the chi-squared value, which uneven
  letters raise in proportion to the length.  These p-values go to the
  Benjamini-Hochberg step-up procedure, separately for each encoding and
  length class, so the expected share of ordinary tokens among the reported is
  at most ``RATE``, whatever the length.

p-values are rounded up to tenths of a decade.  Their histogram (encodings x
length classes x bins, at most a few thousand rows) is all that is gathered.
"""

from __future__ import annotations

import math
from itertools import pairwise

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import materialize
from .common import bind, col

KINDS = ("assign", "access", "hex", "random")
#: Group 2 is the value; keywords in either case.
ASSIGN = (
    r"""([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]"""
    r"""|[Aa][Pp][Ii]_?[Kk][Ee][Yy])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
)
ACCESS = r"AKIA[A-Z0-9]+"
#: Runs of a class are found whole, so asking for 24 finds the same ones as filtering.
HEX = r"[0-9a-f]{24,}"
TOKEN = r"[A-Za-z0-9+/_=-]{20,}"
KEYWORDS = ("password", "passwd", "secret", "token", "api")
LEAST = {"assign": 6, "access": 20}

UPPER, LOWER, DIGITS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz", "0123456789"
#: Encoding, what its tokens must match, classes of its alphabet, and how far ordinary text is from uniform on it.
ENCODINGS = (
    ("hex", r"^(?=.*[0-9])(?=.*[A-Fa-f])([0-9a-f]+|[0-9A-F]+)$", (DIGITS, "abcdef"), 0.6),
    ("base32", r"^(?=.*[2-7])(?=.*[A-Z])[A-Z2-7]+=*$", (UPPER, "234567"), 1.1),
    ("alnum", r"^(?=.*[0-9])(?=.*[A-Za-z])([0-9a-z]+|[0-9A-Z]+)$", (DIGITS, LOWER), 1.1),
    ("base64", r"^(?=.*[A-Z])(?=.*[a-z])(?=.*[0-9])[A-Za-z0-9+/]+=*$", (UPPER, LOWER, DIGITS, "+/"), 3.2),
    ("url64", r"^(?=.*[A-Z])(?=.*[a-z])(?=.*[0-9])[A-Za-z0-9_-]+=*$", (UPPER, LOWER, DIGITS, "-_"), 3.2),
)
#: Encodings that are read without case.
CASELESS = ("hex", "alnum")
#: Letters in the words of the given documents (sf0.01, all languages), a to z, in 1/10,000.
LETTERS = (783, 131, 193, 350, 1668, 98, 130, 865, 704, 12, 17, 308, 60, 1173, 687, 40, 49, 654, 428, 1029, 316, 40, 95, 38, 87, 45)
#: A letter's share is at least this, in 1/10,000: names and abbreviations use the rare ones too.
LEAST_LETTER = 50
#: How often a class of characters follows another one in ordinary long tokens (names in camel case, paths, numbers):
#: assumed, as the given documents have too few of them.  With two classes only, one in five characters changes class.
CHANGE = 0.2
FOLLOWS = {
    "U": {"U": 0.35, "L": 0.55, "D": 0.05, "S": 0.05}, "L": {"U": 0.17, "L": 0.75, "D": 0.04, "S": 0.04},
    "D": {"U": 0.1, "L": 0.1, "D": 0.7, "S": 0.1}, "S": {"U": 0.25, "L": 0.5, "D": 0.2, "S": 0.05},
}
#: Share of the rate for the chi-squared value.
CHI_SHARE = 0.05
LENGTH_CLASSES = (24, 32, 40, 64, 128)
#: Spans of one text are worked on in chunks of so many, so a text of many costs little more for each.
CHUNK = 256
BATTERY = 0.01
RATE = 0.01
MAX_BIN = 400


# --- spans --------------------------------------------------------------------


def chunks(items: Column, size: int = CHUNK) -> Column:
    """An array cut into arrays of ``size``: what is built up step by step is copied within them only."""
    last = F.floor((F.size(items) - 1) / size).cast("int")
    cut = F.transform(F.sequence(F.lit(0), last), lambda i: F.slice(items, i * size + 1, F.lit(size)))
    return F.when(F.size(items) > 0, cut).otherwise(F.slice(F.array(items), 1, 0))


def spans(text: Column, pattern: str, kind: str, keep=None) -> Column:
    """All matches, leftmost and non-overlapping, as structs (start, kind number, end, value) in code points.

    The pieces between matches and the matches themselves give the places.
    ``keep`` filters matches by the values of group 0 (or 2, where there is one).
    """
    number = KINDS.index(kind)
    group = 2 if kind == "assign" else 0

    def of(found: Column) -> Column:
        parts = F.arrays_zip(
            F.transform(F.split(text, pattern, -1), F.length).alias("gap"),
            F.transform(found, F.length).alias("n"),
            F.regexp_extract_all(text, F.lit(pattern), F.lit(group)).alias("value"),
        )
        return bind(F.filter(parts, lambda p: p["n"].isNotNull()), place)

    def place(parts: Column) -> Column:
        return bind(chunks(parts), lambda own: bind(starts(own), lambda at: F.flatten(F.transform(own, lambda c, i: run(c, F.get(at, i))))))

    def starts(own: Column) -> Column:
        """Where each chunk begins."""
        width = lambda c: F.aggregate(c, F.lit(0), lambda n, p: n + p["gap"] + p["n"])
        first = F.array(F.lit(0))
        return F.aggregate(own, first, lambda acc, c: F.concat(acc, F.array(F.element_at(acc, -1) + width(c))))

    def run(c: Column, at: Column) -> Column:
        empty = F.array().cast("array<struct<start:int,kind:int,end:int,value:string>>")
        start = F.struct(at.alias("at"), empty.alias("out"))

        def add(acc: Column, p: Column) -> Column:
            low = acc["at"] + p["gap"]
            one = F.struct(low.alias("start"), F.lit(number).alias("kind"), (low + p["n"]).alias("end"), p["value"].alias("value"))
            return F.struct((low + p["n"]).alias("at"), F.concat(acc["out"], F.array(one)).alias("out"))

        return F.aggregate(c, start, add, lambda acc: acc["out"])

    found = bind(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), of)
    return F.filter(found, keep) if keep else found


def base_spans(text: Column) -> Column:
    """Spans of the fixed patterns, by start, then kind."""
    none = F.array().cast("array<struct<start:int,kind:int,end:int,value:string>>")
    lower = F.lower(text)
    any_word = F.lit(False)
    for w in KEYWORDS:
        any_word = any_word | lower.contains(w)
    assign = spans(text, ASSIGN, "assign", lambda s: F.length(s["value"]) >= LEAST["assign"])
    access = spans(text, ACCESS, "access", lambda s: s["end"] - s["start"] >= LEAST["access"])
    return F.sort_array(
        F.concat(
            F.when(any_word, assign).otherwise(none),
            F.when(text.contains("AKIA"), access).otherwise(none),
            F.when(text.rlike(HEX), spans(text, HEX, "hex")).otherwise(none),
        )
    )


# --- tests on one token -------------------------------------------------------


def _upper_tail(z: Column) -> Column:
    """P(Z > z) of the normal distribution (a published rational approximation of erfc)."""
    x = F.abs(z) / math.sqrt(2)
    t = 1 / (1 + 0.3275911 * x)
    poly = t * (0.254829592 + t * (-0.284496736 + t * (1.421413741 + t * (-1.453152027 + t * 1.061405429))))
    half = poly * F.exp(-x * x) / 2
    return F.when(z >= 0, half).otherwise(1 - half)


def _chi_tail(chi: Column, df: Column) -> Column:
    """P of a larger chi-squared value, by Wilson and Hilferty's normal form."""
    part = 2 / (9 * df)
    return _upper_tail((F.pow(F.greatest(chi, F.lit(0.0)) / df, F.lit(1 / 3)) - (1 - part)) / F.sqrt(part))


def _add(xs: Column, f) -> Column:
    return F.aggregate(xs, F.lit(0.0), lambda acc, v: acc + f(v))


def _evidence(classes: tuple[str, ...]) -> dict[str, list]:
    """Log-likelihood ratios of a uniform key to ordinary text: per character, and per class after a class.

    ``steps`` has a row per class before; ``class_of`` the class of each character.
    """
    kind = lambda c: "U" if c in UPPER else "L" if c in LOWER else "D" if c in DIGITS else "S"
    kinds, size = [kind(c[0]) for c in classes], sum(map(len, classes))
    chars = []
    for members in classes:
        # digits and signs of ordinary text count as even
        share = [max(LETTERS[LOWER.index(c)], LEAST_LETTER) if c in LOWER else 1 for c in members.lower()]
        chars += [math.log(sum(share) / (len(members) * x)) for x in share]
    follows = lambda a, b: FOLLOWS[a][b] if len(kinds) > 2 else 1 - CHANGE if a == b else CHANGE
    steps = [math.log(len(c) / size / follows(a, b)) for a in kinds for b, c in zip(kinds, classes)]
    return {"chars": chars, "steps": steps, "class_of": [float(i) for i, c in enumerate(classes) for _ in c]}


def _codes(e: Column, body: Column) -> Column:
    """The token as places in the alphabet of its encoding, with what depends on the encoding."""
    value = F.when(e["name"].isin(*CASELESS), F.lower(body)).otherwise(body)
    x = F.transform(F.split(value, ""), lambda c: F.instr(e["alphabet"], c) - 1)
    k = F.length(e["alphabet"])
    n = F.size(x).cast("double")
    given = F.struct(
        e["name"].alias("name"), e["classes"].alias("classes"), e["apart"].alias("apart"), k.cast("double").alias("k"),
        x.alias("x"), n.alias("n"), (_add(x, lambda v: v) / n).alias("mean"),
        F.transform(x, lambda v: v >= k / 2).alias("high"), e["chars"].alias("chars"), e["steps"].alias("steps"),
        F.transform(x, lambda v: F.get(e["class_of"], v)).alias("own"),
    )
    return bind(given, _sums)


def _sums(s: Column) -> Column:
    """What the statistics need of the whole token, each part once."""
    x, n, k, mean, high = (s[c] for c in ("x", "n", "k", "mean", "high"))
    square = _add(F.array_distinct(x), lambda v: F.pow(F.size(F.filter(x, lambda y: y == v)), F.lit(2.0)))

    def class_term(c: Column) -> Column:
        own = F.size(F.filter(x, lambda v: (v >= c["low"]) & (v < c["high"])))
        expected = n * (c["high"] - c["low"]) / k
        return F.pow(own - expected, F.lit(2.0)) / expected

    def step(i: Column) -> Column:
        before, after = F.get(s["own"], i - 1), F.get(s["own"], i)
        return F.get(s["steps"], (before * F.size(s["classes"]) + after).cast("int"))

    neighbours = F.sequence(F.lit(1), F.size(x) - 1)
    found = {
        "name": s["name"], "apart": s["apart"], "n": n, "df": k - 1, "chi": square * k / n - n,
        "class_df": F.size(s["classes"]).cast("double") - 1, "chi_class": _add(s["classes"], class_term),
        "changes": F.size(F.filter(neighbours, lambda i: F.get(high, i) != F.get(high, i - 1))).cast("double"),
        "n1": F.size(F.filter(high, lambda v: v)).cast("double"),
        "ratio": _add(x, lambda v: F.get(s["chars"], v)) + _add(neighbours, step),
        "var": _add(x, lambda v: (v - mean) * (v - mean)),
        "lag": _add(neighbours, lambda i: (F.get(x, i) - mean) * (F.get(x, i - 1) - mean)),
    }
    return bind(F.struct(*[c.alias(name) for name, c in found.items()]), _grade)


def _grade(s: Column) -> Column:
    """The battery's and the text's p-values, and where the token stands in the procedure."""
    n, n1, df = s["n"], s["n1"], s["df"]
    expected = 2 * n1 * (n - n1) / n + 1
    spread = F.sqrt(F.greatest((expected - 1) * (expected - 2) / (n - 1), F.lit(0.0)))
    far = F.lit(40.0)
    z_runs = F.when((n1 < 1) | (n1 >= n) | (spread <= 0), far).otherwise(F.try_divide(s["changes"] + 1 - expected, spread))
    z_lag = F.when(s["var"] <= 0, far).otherwise((F.try_divide(s["lag"], s["var"]) + 1 / n) * F.sqrt(n))
    uniform = F.least(_chi_tail(s["chi"], df), _chi_tail(s["chi_class"], s["class_df"]))
    worst = F.least(uniform, 2 * _upper_tail(F.greatest(F.abs(z_runs), F.abs(z_lag))))
    z_text = (s["chi"] - df - n * s["apart"]) / F.sqrt(2 * df + 4 * n * s["apart"])
    tenth = F.floor(-10 * F.log10(F.greatest(_upper_tail(-z_text), F.lit(1e-300)))).cast("int")
    # in tenths of a decade, each with its share of the rate
    likely = F.floor(10 * (s["ratio"] / math.log(10) + math.log10(1 - CHI_SHARE))).cast("int")
    both = F.greatest(likely, tenth + math.floor(10 * math.log10(CHI_SHARE)))
    step = F.lit(0)
    for limit in LENGTH_CLASSES:
        step = step + (n >= limit).cast("int")
    return F.struct(
        F.concat_ws(":", s["name"], step.cast("string")).alias("stratum"),
        F.least(F.greatest(tenth, F.lit(0)), F.lit(MAX_BIN)).alias("bin"),
        F.least(F.greatest(both, F.lit(0)), F.lit(MAX_BIN)).alias("combined"),
        F.least(4 * worst, F.lit(1.0)).alias("battery"),
    )


def _encoding(token: Column) -> Column:
    """The first encoding that the token fits; null where it fits none."""
    out = F.lit(None)
    for name, form, classes, apart in reversed(ENCODINGS):
        ends = [sum(map(len, classes[:i])) for i in range(len(classes) + 1)]
        parts = [F.struct(F.lit(a).alias("low"), F.lit(b).alias("high")) for a, b in pairwise(ends)]
        known = {"name": F.lit(name), "alphabet": F.lit("".join(classes)), "classes": F.array(*parts), "apart": F.lit(apart)}
        known |= {n: F.array(*map(F.lit, v)) for n, v in _evidence(classes).items()}
        out = F.when(token.rlike(form), F.struct(*[c.alias(n) for n, c in known.items()])).otherwise(out)
    return out


def tested(token: Column) -> Column:
    """struct(stratum, bin, combined, battery) of a token; null where no encoding can be inferred.

    ``bin`` is that of the chi-squared value alone, ``combined`` that of both p-values.
    """
    body = F.rtrim(F.translate(token, "=", " "))
    return bind(_encoding(token), lambda e: F.when(e.isNotNull(), _codes(e, body)))


def candidates(text: Column, base: Column) -> Column:
    """Long tokens that touch no base span, with their tests."""
    found = spans(text, TOKEN, "random")
    graded_by = lambda t: F.when(t.isNotNull(), F.struct(t["stratum"].alias("stratum"), t["combined"].alias("bin"), t["battery"].alias("battery")))

    def untouched(parts: Column) -> Column:
        meets = lambda b, s: (b["start"] < s["end"]) & (s["start"] < b["end"])
        return F.filter(found, lambda s: ~F.exists(parts, lambda p: meets(p, s) & F.exists(p["own"], lambda b: meets(b, s))))

    def bounds(own: Column) -> Column:
        low, high = (f(F.transform(own, lambda b: b[name])) for f, name in ((F.array_min, "start"), (F.array_max, "end")))
        return F.struct(low.alias("start"), high.alias("end"), own.alias("own"))

    free = bind(F.transform(chunks(base), bounds), untouched)
    graded = F.transform(
        free, lambda s: F.struct(s["start"].alias("start"), s["kind"].alias("kind"), s["end"].alias("end"), bind(tested(s["value"]), graded_by).alias("test"))
    )
    none = F.array().cast("array<struct<start:int,kind:int,end:int,test:struct<stratum:string,bin:int,battery:double>>>")
    return F.when(text.rlike(TOKEN), F.filter(graded, lambda s: s["test"].isNotNull())).otherwise(none)


# --- whole tables -------------------------------------------------------------


def scanned(docs: DataFrame, text: str = "text", base: str = "_base", tokens: str = "_tokens") -> DataFrame:
    """``docs`` plus base spans and tested tokens under these names; a null text counts as empty."""
    value = F.coalesce(col(text), F.lit(""))
    with_base = docs.withColumn(base, base_spans(value))
    return with_base.withColumn(tokens, candidates(value, F.col(base)))


def thresholds(tokens: DataFrame, rate: float = RATE) -> dict[str, int]:
    """Per stratum the smallest bin that the step-up procedure still reports.

    ``tokens`` has a ``_tokens`` column.  Only the histogram is ordered, inside
    its strata.
    """
    each = tokens.select(F.explode("_tokens").alias("t")).select("t.test.stratum", "t.test.bin")
    bins = each.groupBy("stratum", "bin").agg(F.count(F.lit(1)).alias("n"))
    beyond = Window.partitionBy("stratum").orderBy(F.desc("bin")).rowsBetween(Window.unboundedPreceding, 0)
    everything = Window.partitionBy("stratum")
    ranked = bins.select("stratum", "bin", F.sum("n").over(beyond).alias("found"), F.sum("n").over(everything).alias("m"))
    p = F.pow(F.lit(10.0), -F.col("bin") / 10)
    passed = ranked.where(p * F.col("m") <= rate * F.col("found"))
    # one row per encoding and length class
    return {r["stratum"]: r["low"] for r in passed.groupBy("stratum").agg(F.min("bin").alias("low")).collect()}


def plain(spans_: Column) -> Column:
    """Spans without what was found out about them."""
    return F.transform(
        spans_, lambda s: F.struct(s["start"].alias("start"), s["kind"].alias("kind"), s["end"].alias("end"))
    )


def all_spans(limits: dict[str, int], base: str = "_base", tokens: str = "_tokens") -> Column:
    """Base spans and reported tokens of a scanned row, by start, then kind."""
    if not limits:
        extra = F.filter(tokens, lambda s: F.lit(False))
    else:
        low = F.create_map(*[F.lit(x) for pair in sorted(limits.items()) for x in pair])
        extra = F.filter(
            tokens,
            lambda s: F.coalesce(s["test"]["bin"] >= F.try_element_at(low, s["test"]["stratum"]), F.lit(False))
            & (s["test"]["battery"] >= BATTERY),
        )
    return F.sort_array(F.concat(plain(F.col(base)), plain(extra)))


def joined(spans_: Column) -> Column:
    """kind:start:end of all spans, comma-joined."""
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans_, lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"], s["end"])), ",")


def scan_secrets(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", rate: float = RATE) -> DataFrame:
    """``doc_id``, counts per kind, ``base`` and ``spans`` (arrays of start, kind, end) of each row.

    Texts are read once; the spans go through a written table, as the thresholds
    depend on all of them.
    """
    narrow = materialize(scanned(docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))).drop("text"), "spans")
    every = narrow.withColumn("spans", all_spans(thresholds(narrow, rate)))
    count = lambda name, k: F.size(F.filter(name, lambda s: s["kind"] == KINDS.index(k))).cast("bigint")
    return every.select(
        "doc_id",
        *[count("_base", k).alias(f"n_{k}") for k in KINDS[:3]],
        count("spans", "random").alias("n_random"),
        plain(F.col("_base")).alias("base"),
        "spans",
    )


def redact(docs: DataFrame, text: str = "text", mark: str = "[secret]", rate: float = RATE) -> DataFrame:
    """``docs`` with every span of its texts replaced by ``mark``; overlapping spans become one.

    Rows without spans, null texts among them, are left as they are.
    """
    limits = thresholds(scanned(docs.select(F.col(text)), text).select("_tokens"), rate)
    value = F.col(text)

    def cut(found: Column) -> Column:
        start = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))

        def add(acc: Column, s: Column) -> Column:
            gap = F.substring(value, acc["at"] + 1, s["start"] - acc["at"])
            fresh = F.struct(s["end"].alias("at"), F.concat(acc["out"], gap, F.lit(mark)).alias("out"))
            wider = F.struct(F.greatest(acc["at"], s["end"]).alias("at"), acc["out"].alias("out"))
            return F.when(s["start"] >= acc["at"], fresh).otherwise(wider)

        rest = lambda acc: F.concat(acc["out"], F.substring(value, acc["at"] + 1, F.length(value)))
        return F.when(F.size(found) == 0, value).otherwise(F.aggregate(found, start, add, rest))

    taken = {c.lower() for c in docs.columns}
    base, tokens = (next(n for n in (f"_{kind}{i}" for i in range(len(taken) + 1)) if n not in taken) for kind in ("base", "tokens"))
    marked = scanned(docs, text, base, tokens).withColumn(text, bind(all_spans(limits, base, tokens), cut))
    return marked.select(*docs.columns)
