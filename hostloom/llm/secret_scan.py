"""Secrets in texts: fixed patterns plus a randomness battery over unexplained tokens.

Everything is built from Spark's own functions. One pass over the texts finds
the spans of the fixed patterns and of long unbroken tokens; an equals sign
belongs to a token only as padding at its end. For each token the encoding is
inferred (hexadecimal, base32, base36, base62, base64 or the signs of both
base64 forms together) and three tests ask whether its symbols could be uniform
random draws:

* chi-squared of the symbol counts against a uniform alphabet, with the
  Wilson-Hilferty cube root, which holds for short tokens too;
* the number of runs in the upper and lower half of the alphabet;
* the correlation of each symbol with the next.

Fisher's method joins the three into one p-value. A fourth test asks whether the
letters, their case aside, could be uniform draws from 26, against letters as common
as in prose, since words of one case pass the others; twice the lesser of both
p-values counts. A token with ``+ / _ -`` is
also read without these separators, as keys in groups are; the greater p-value
counts. If the token is dismissed its long parts between separators are judged
by themselves, as for a key in a path. Tokens without a letter are numbers and
are left to the fixed patterns. Words and names in code
reject randomness, keys do not. Which tokens may be dismissed as not random is
decided by the Benjamini-Hochberg rule separately in each band of lengths,
since short tokens carry less evidence: of those dismissed at most the share
``rate`` are expected to be random. What is not dismissed is a secret. The rule
needs only the counts of p-values on a fine grid, so nothing is ranked or
gathered.

Null texts count as empty. Spans are in code points, their end exclusive. Each
row is answered by itself, so repeated rows, null ids and extra columns do no
harm; an empty table gives an empty one.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from hostloom.llm.common import settle

# Fixed values of the contract: patterns, in the order in which kinds are listed.
ASSIGN = r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ASSIGN_LEAST = 12
# a run of at least that many characters is the same as a maximal run filtered by its length
ACCESS = r"AKIA[A-Z0-9]{14,}"
HEX = r"[0-9a-f]{16,}"
KINDS = ("assign", "access", "hex", "random")

_SPANS = "array<struct<s:int,e:int,g:string>>"
_BLOCK = 128


@dataclass(frozen=True)
class Battery:
    """``least``: shortest token tested; ``bands``: lower ends of the length bands; ``rate``: false discovery rate."""

    least: int = 20
    bands: tuple[int, ...] = (20, 24, 32, 48, 64, 128)
    rate: float = 0.05
    grid: int = 20


def _matches(pattern: str, group: int = 0) -> Column:
    return F.regexp_extract_all("text", F.lit(pattern), F.lit(group))


def _positions(pattern: str, found: Column, groups: Column) -> Column:
    """Spans of ``found``, the matches of ``pattern`` in ``text``, in order.

    The texts between matches give the offsets. They are summed in blocks, so
    that a text with very many matches does not copy its list for each of them.
    """
    between = F.split("text", pattern, -1)
    parts = F.transform(F.arrays_zip(found.alias("m"), groups.alias("g"), between.alias("b")),
                        lambda x: F.struct(F.length(x["b"]).alias("b"), F.length(x["m"]).alias("m"),
                                           x["g"].alias("g")))
    parts = F.filter(parts, lambda x: x["m"].isNotNull())
    empty = F.array().cast(_SPANS)
    start = F.struct(F.lit(0).alias("at"), empty.alias("out"))

    def step(acc: Column, x: Column) -> Column:
        s = acc["at"] + x["b"]
        span = F.struct(s.alias("s"), (s + x["m"]).alias("e"), x["g"].alias("g"))
        return F.struct((s + x["m"]).alias("at"), F.concat(acc["out"], F.array(span).cast(_SPANS)).alias("out"))

    def join(acc: Column, block: Column) -> Column:
        moved = F.transform(block["out"], lambda y: F.struct(
            (y["s"] + acc["at"]).alias("s"), (y["e"] + acc["at"]).alias("e"), y["g"].alias("g")))
        return F.struct((acc["at"] + block["at"]).alias("at"),
                        F.concat(acc["out"], moved.cast(_SPANS)).alias("out"))

    blocks = F.transform(F.sequence(F.lit(0), F.floor((F.size(found) - 1) / _BLOCK).cast("int")),
                         lambda b: F.aggregate(F.slice(parts, b * _BLOCK + 1, F.lit(_BLOCK)), start, step))
    return F.when(F.size(found) > 0, F.aggregate(blocks, start, join)["out"]).otherwise(empty)


def _tail(z: Column) -> Column:
    """P(Z > z) of a standard normal; Abramowitz and Stegun 26.2.17, fixed coefficients."""
    t = 1 / (1 + 0.2316419 * F.abs(z))
    series = t * (0.319381530 + t * (-0.356563782 + t * (1.781477937 + t * (-1.821255978 + t * 1.330274429))))
    upper = F.exp(-z * z / 2) * 0.3989422804014327 * series
    return F.greatest(F.when(z >= 0, upper).otherwise(1 - upper), F.lit(1e-15))


def encoding_of(token: Column) -> Column:
    """Name of the narrowest alphabet that explains a token; null for numbers."""
    bare = F.regexp_replace(token, "=+$", "")
    return (
        F.when(~bare.rlike("[A-Za-z]"), None)
        .when(bare.rlike("^([0-9a-f]+|[0-9A-F]+)$"), "hex")
        .when(bare.rlike("^[A-Z2-7]+$"), "base32")
        .when(bare.rlike("^([a-z0-9]+|[A-Z0-9]+)$"), "base36")
        .when(bare.rlike("^[A-Za-z0-9]+$"), "base62")
        .when(bare.rlike("^([A-Za-z0-9+/]+|[A-Za-z0-9_-]+)$"), "base64")
        .when(bare.rlike("^[A-Za-z0-9+/_-]+$"), "base66"))


_UPPER, _LOWER, _DIGITS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz", "0123456789"
ALPHABETS = {"hex": _DIGITS + "abcdef", "base32": _UPPER + "234567", "base36": _DIGITS + _LOWER,
             "base62": _UPPER + _LOWER + _DIGITS, "base64": _UPPER + _LOWER + _DIGITS + "+/",
             "base66": _UPPER + _LOWER + _DIGITS + "+/-_"}


# Percent of each letter, a to z, in English prose; rare ones as 0.3, as other languages use them more.
PROSE = (8.2, 1.5, 2.8, 4.3, 12.7, 2.2, 2.0, 6.1, 7.0, 0.3, 0.8, 4.0, 2.4,
         6.7, 7.5, 1.9, 0.3, 6.0, 6.3, 9.1, 2.8, 1.0, 2.4, 0.3, 2.0, 0.3)
_LEAST_LETTERS = 8


def _letters(token: Column) -> Column:
    """For each letter of a token the logarithm of how much commoner it is in prose than in uniform draws."""
    scores = F.array(*[F.lit(math.log(26 * p / 100)) for p in PROSE])
    letters = F.split(F.regexp_replace(F.lower(token), "[^a-z]", ""), "")
    return F.transform(F.filter(letters, lambda c: c != ""), lambda c: F.element_at(scores, F.instr(F.lit(_LOWER), c)))


def _unlike_prose(scores: Column, k: Column) -> Column:
    """P-value of letters at least as like prose; 1 for few letters and for hexadecimal tokens, which use six of them."""
    values = [math.log(26 * p / 100) for p in PROSE]
    mean = sum(values) / 26
    spread = math.sqrt(sum((v - mean) ** 2 for v in values) / 26)
    n = F.size(scores).cast("double")
    above = F.aggregate(scores, F.lit(0.0), lambda acc, x: acc + (x - mean))
    return F.when((n >= _LEAST_LETTERS) & (k > 16), _tail(above / (spread * F.sqrt(n)))).otherwise(F.lit(1.0))


def randomness(token: Column, encoding: Column) -> Column:
    """Joint p-value of the battery for a token under its encoding: small when it is not random."""
    bare = F.regexp_replace(token, "=+$", "")
    bare = F.when(encoding == "base64", F.translate(bare, "-_", "+/")).otherwise(bare)
    bare = F.when(encoding.isin("hex", "base36"), F.lower(bare)).otherwise(bare)
    alphabet = F.element_at(F.create_map(*[F.lit(x) for pair in ALPHABETS.items() for x in pair]), encoding)
    known = F.struct(
        F.transform(F.filter(F.split(bare, ""), lambda c: c != ""), lambda c: F.instr(alphabet, c).cast("double"))
        .alias("x"), F.length(alphabet).cast("double").alias("k"), _letters(bare).alias("l"))

    def test(v: Column) -> Column:
        x, k = v["x"], v["k"]
        n = F.size(x).cast("double")
        squares = F.aggregate(F.sequence(F.lit(1), k.cast("int")), F.lit(0.0), lambda acc, a: acc + F.pow(
            F.size(F.filter(x, lambda y: y == a)).cast("double"), F.lit(2.0)))
        free = k - 1
        spread = 2 / (9 * free)
        uneven = _tail((F.pow((k / n * squares - n) / free, F.lit(1 / 3)) - (1 - spread)) / F.sqrt(spread))
        pairs = F.zip_with(F.slice(x, F.lit(1), F.size(x) - 1), F.slice(x, F.lit(2), F.size(x) - 1),
                           lambda a, b: F.struct(a.alias("a"), b.alias("b")))
        turns = F.size(F.filter(pairs, lambda q: (q["a"] > k / 2) != (q["b"] > k / 2))).cast("double")
        runs = 2 * _tail(F.abs(turns - (n - 1) / 2) / F.sqrt((n - 1) / 4))
        centre = (k + 1) / 2
        products = F.aggregate(pairs, F.lit(0.0), lambda acc, q: acc + (q["a"] - centre) * (q["b"] - centre))
        serial = 2 * _tail(F.abs(products) / ((k * k - 1) / 12 * F.sqrt(n - 1)))
        half = -(F.log(uneven) + F.log(F.least(runs, F.lit(1.0))) + F.log(F.least(serial, F.lit(1.0))))
        joined = F.exp(-half) * (1 + half + half * half / 2)
        return F.least(F.lit(1.0), 2 * F.least(joined, _unlike_prose(v["l"], k)))

    # a one-element list, so that what all tests share is worked out once
    return F.element_at(F.transform(F.array(known), test), 1)


def _band(length: Column, how: Battery) -> Column:
    band = F.lit(how.bands[0])
    for low in how.bands[1:]:
        band = F.when(length >= low, low).otherwise(band)
    return band


def _token_pattern(how: Battery) -> str:
    return r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{%d,}(?:=+(?![A-Za-z0-9+/_=-]))?" % how.least


def _parts(token: Column, how: Battery) -> Column:
    """Spans of the parts of a token between separators that are long enough to test; none if it has no separator."""
    empty = F.array().cast(_SPANS)

    def step(acc: Column, x: Column) -> Column:
        span = F.struct(acc["at"].alias("s"), (acc["at"] + F.length(x)).alias("e"), x.alias("g"))
        out = F.when(F.length(F.regexp_replace(x, "=+$", "")) >= how.least,
                     F.concat(acc["out"], F.array(span).cast(_SPANS))).otherwise(acc["out"])
        return F.struct((acc["at"] + F.length(x) + 1).alias("at"), out.alias("out"))

    start = F.struct(token["s"].alias("at"), empty.alias("out"))
    return F.when(token["g"].rlike("[+/_-]"), F.aggregate(F.split(token["g"], "[+/_-]", -1), start, step)["out"]
                  ).otherwise(empty)


def _read(span: Column, token: Column, how: Battery) -> Column:
    """A span with its token's span and its two readings, as it is and without separators; null where not to be tested."""
    as_is, closed = span["g"], F.translate(span["g"], "+/_-", "")

    def usable(text: Column) -> Column:
        return F.when(F.length(F.regexp_replace(text, "=+$", "")) >= how.least, text)

    return F.struct(span["s"].alias("s"), span["e"].alias("e"), token["s"].alias("ts"), token["e"].alias("te"),
                    _band(F.length(as_is), how).alias("band"), usable(as_is).alias("g1"),
                    F.when(as_is.rlike("[+/_-]"), usable(closed)).alias("g2"))


def _bin(reading: Column, how: Battery) -> Column:
    """Place on the grid of p-values, null for no reading."""
    return F.when(reading["enc"].isNotNull(), F.floor(
        -F.log10(randomness(reading["g"], reading["enc"])) * how.grid).cast("int"))


def examined(docs: DataFrame, how: Battery, id_col: str, text_col: str) -> DataFrame:
    """Per row the base spans ``(s, k, e)`` and the tested tokens with band and place on the grid of p-values."""
    texts = docs.select(F.col(id_col).cast("bigint").alias("doc_id"),
                        F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    token = _token_pattern(how)
    # behind a generator each list of matches is computed once
    found = texts.select("doc_id", "text", F.explode(F.array(F.struct(
        _matches(ASSIGN).alias("assign"), _matches(ASSIGN, 2).alias("values"), _matches(ACCESS).alias("access"),
        _matches(HEX).alias("hex"), _matches(token).alias("tokens")))).alias("f"))
    found = found.select("doc_id", F.explode(F.array(F.struct(
        F.filter(_positions(ASSIGN, F.col("f.assign"), F.col("f.values")),
                 lambda x: F.length(x["g"]) >= ASSIGN_LEAST).alias("assign"),
        _positions(ACCESS, F.col("f.access"), F.col("f.access")).alias("access"),
        _positions(HEX, F.col("f.hex"), F.col("f.hex")).alias("hex"),
        _positions(token, F.col("f.tokens"), F.col("f.tokens")).alias("tokens")))).alias("f"))

    def kind(name: str) -> Column:
        return F.transform(F.col(f"f.{name}"), lambda x: F.struct(
            x["s"].alias("s"), F.lit(KINDS.index(name)).alias("k"), x["e"].alias("e")))

    base = F.array_sort(F.concat(kind("assign"), kind("access"), kind("hex")))
    rows = found.select(
        "doc_id", *[F.size(f"f.{k}").cast("bigint").alias(f"n_{k}") for k in KINDS[:3]], base.alias("base"),
        F.flatten(F.transform("f.tokens", lambda x: F.transform(
            F.concat(F.array(x), _parts(x, how)), lambda y: _read(y, x, how)))).alias("read"))
    # what a pattern already covers needs no test
    free = F.filter("read", lambda x: ~F.exists("base", lambda b: (b["s"] < x["e"]) & (x["s"] < b["e"])))
    kept = ["doc_id", *[f"n_{k}" for k in KINDS[:3]], "base"]
    # the battery nests deeply already: its arguments come from generators, which Spark does not merge with it
    rows = rows.select(*kept, F.explode(F.array(free)).alias("read"))
    texts = [F.transform(f"read.{g}", lambda t: F.struct(t.alias("g"), encoding_of(t).alias("enc"))).alias(g)
             for g in ("g1", "g2")]
    rows = rows.select(*kept, "read", F.explode(F.array(F.struct(*texts))).alias("c"))
    bins = [F.transform(f"c.{g}", lambda x: _bin(x, how)).alias(g) for g in ("g1", "g2")]
    rows = rows.select(*kept, "read", F.explode(F.array(F.struct(*bins))).alias("b"))
    tested = F.transform(F.arrays_zip(F.col("read").alias("r"), F.col("b.g1").alias("a"), F.col("b.g2").alias("b")),
                         lambda x: F.struct(*[x["r"][k].alias(k) for k in ("s", "e", "ts", "te", "band")],
                                            F.least(x["a"], x["b"]).alias("bin")))
    return rows.select(*kept, F.filter(tested, lambda t: t["bin"].isNotNull()).alias("tested"))


def dismissal(tested: DataFrame, how: Battery) -> DataFrame:
    """One row with ``cuts``: per band the grid place from which tokens are dismissed as not random."""
    counts = tested.select(F.explode("tested").alias("t")).groupBy("t.band", "t.bin").agg(
        F.count(F.lit(1)).alias("n"))
    # at most one row per band and grid place, whatever the corpus
    above = Window.partitionBy("band").orderBy(F.desc("bin"))
    ranked = counts.withColumn("rank", F.sum("n").over(above)).withColumn(
        "all", F.sum("n").over(Window.partitionBy("band")))
    passed = ranked.filter(F.pow(F.lit(10.0), -F.col("bin") / how.grid) <= how.rate * F.col("rank") / F.col("all"))
    cuts = passed.groupBy("band").agg(F.min("bin").alias("cut"))
    return cuts.agg(F.map_from_entries(F.collect_list(F.struct("band", "cut"))).alias("cuts"))


def secret_spans(docs: DataFrame, how: Battery = Battery(), id_col: str = "doc_id",
                 text_col: str = "text") -> DataFrame:
    """(doc_id, n_assign, n_access, n_hex, n_random, base, spans) for each row; spans are lists of ``(s, k, e)``."""
    rows = settle(examined(docs, how, id_col, text_col), "secrets")
    cuts = dismissal(rows, how).scalar()
    kept = F.filter("tested", lambda t: F.coalesce(t["bin"] < F.element_at(F.col("cuts"), t["band"]), F.lit(True)))
    rows = rows.withColumn("cuts", cuts).withColumn("kept", kept)
    rows = rows.withColumn("whole", F.transform(F.filter(
        "kept", lambda t: (t["s"] == t["ts"]) & (t["e"] == t["te"])), lambda t: t["s"]))
    # parts count where their token does not
    kept = F.filter("kept", lambda t: ((t["s"] == t["ts"]) & (t["e"] == t["te"])) | ~F.array_contains("whole", t["ts"]))
    random = F.transform(kept, lambda t: F.struct(t["s"].alias("s"), F.lit(3).alias("k"), t["e"].alias("e")))
    return (rows.withColumn("random", random)
            .select("doc_id", *[f"n_{k}" for k in KINDS[:3]], F.size("random").cast("bigint").alias("n_random"),
                    "base", F.array_sort(F.concat("base", "random")).alias("spans")))


def spelled(spans: str) -> Column:
    """A list of spans as ``kind:start:end``, comma-joined."""
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(
        ":", names[x["k"]], x["s"].cast("string"), x["e"].cast("string"))), ",")
