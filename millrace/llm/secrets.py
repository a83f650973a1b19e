"""Secret scans: patterns, and a randomness test battery with false-discovery control.

Base kinds are patterns (`assign`, `access`, `hex`). The battery looks at all
other long tokens with a letter. UUIDs and digests (hex of a digest's length,
between other symbols) look random and are ordinary: they are cut out of a token
first. It infers each one's encoding
(hex, base32 or base64; of the last, letters and digits are tested, for its
other symbols also part the words of ordinary tokens) and asks of three
statistics how likely an ordinary token (an identifier, a path, a name with a
number) is to look as random as this:

* chi-squared of its symbols against a uniform alphabet, low if random, taken
  as the share of pairs of equal symbols;
* runs of symbol classes (upper, lower, digit), many if random: a word may
  begin with a capital, so a step from upper to lower case is none;
* serial correlation of its symbols, none if random.

Each is a standard score under the ordinary token of its encoding: tokens differ
among themselves as well as by chance, so a score is bounded however long the
token is. The three are combined by Stouffer's weighted sum; weights and spreads
were fitted to some 5000 tokens of source code, and what they report on others is
in the README. Long tokens hold more of the real secrets, but a token of ten times
the length is no ten times likelier to be one: each p-value is divided by the
logarithm of its token's length over the mean of these (weighted
Benjamini-Hochberg), and tokens are reported at a false-discovery rate of ``FDR`` over the whole corpus.

DataFrame functions only. Positions are code points, ends exclusive.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import fresh, keep, let, running_totals, table

# The base patterns, with the group and the least length that count.
KINDS = {
    "assign": (
        r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 8,
    ),
    "access": (r"AKIA[A-Z0-9]+", 0, 16),
    "hex": (r"[0-9a-f]+", 0, 32),
}
#: Texts without a match of these have no kept match of the kind.
LIKELY = {"assign": KINDS["assign"][0], "access": r"AKIA[A-Z0-9]{12}", "hex": r"[0-9a-f]{32}"}
RANDOM = "random"
#: Tokens the battery looks at, of any length and after any other symbol ("=" included), with their padding.
CANDIDATE = r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{20,}+(?:={1,2}+(?![A-Za-z0-9+/_=-]))?"
#: Fewer letters and digits than this, without UUIDs and digests, tell nothing.
LEAST_SYMBOLS = 10
FDR = 0.05

# Lengths of digests in hex (MD5, SHA-1, SHA-224, SHA-256, SHA-384, SHA-512), and the shape of a UUID.
DIGESTS = (32, 40, 56, 64, 96, 128)
UUID = "[0-9a-fA-F]{8}(?:-[0-9a-fA-F]{4}){3}-[0-9a-fA-F]{12}"
IDS = "(?<![A-Za-z0-9])(?:" + "|".join([UUID, *(f"[0-9a-f]{{{n}}}|[0-9A-F]{{{n}}}" for n in DIGESTS)]) + ")(?![A-Za-z0-9])"

# The alphabets of the encodings, in the order of their symbols.
HEX = "0123456789abcdef"
BASE32 = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
BASE64 = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789"

#: What ordinary tokens are like, by the size of the alphabet: chance that two of their symbols are equal,
#: that a symbol is of another class than the one before, and their serial correlation.
ORDINARY = {16: (0.125, 0.2, 0.15), 32: (0.08, 0.1, 0.15), 62: (0.05, 0.09, 0.15)}
#: Standard deviations of these three: among tokens, and by chance (over the root of the length).
SPREAD = ((0.012, 0.09), (0.04, 0.25), (0.15, 1.1))
#: Weights of the three in the sum.
WEIGHTS = (0.55, 0.8, 0.1)
_BLOCK = 64


def prefix_sums(values: Column) -> Column:
    """Sums of an array's entries before each entry, and of all at the end."""
    n_blocks = F.ceil(F.size(values) / F.lit(_BLOCK)).cast("int")
    total = lambda a: F.aggregate(a, F.lit(0), lambda x, y: x + y)
    blocks = F.transform(
        F.sequence(F.lit(0), n_blocks), lambda b: total(F.slice(values, b * _BLOCK + 1, F.lit(_BLOCK)))
    )
    before = F.aggregate(
        blocks, F.array(F.lit(0)), lambda sums, b: F.concat(sums, F.array(F.element_at(sums, -1) + b))
    )

    def at(before: Column) -> Column:
        return F.transform(
            F.sequence(F.lit(0), F.size(values)),
            lambda i: F.get(before, F.floor(i / _BLOCK).cast("int"))
            + total(F.slice(values, F.floor(i / _BLOCK).cast("int") * _BLOCK + 1, i % _BLOCK)),
        )

    return let(before, at)


def matches(text: Column, pattern: str, group: int = 0) -> Column:
    """start, end and value (the group) of each match, leftmost and non-overlapping.

    The text between matches, by splitting, and the matches themselves take
    turns, so their lengths add up to the positions.
    """
    found = F.struct(
        F.transform(F.split(text, pattern, -1), lambda p: F.char_length(p)).alias("gaps"),
        F.transform(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), lambda m: F.char_length(m)).alias("lengths"),
        F.regexp_extract_all(text, F.lit(pattern), F.lit(group)).alias("values"),
    )

    def place(f: Column) -> Column:
        def spans(gaps: Column, lengths: Column) -> Column:
            start = lambda i: F.get(gaps, i + 1) + F.get(lengths, i)
            return F.transform(
                f["values"],
                lambda v, i: F.struct(
                    start(i).alias("start"), (start(i) + F.get(f["lengths"], i)).alias("end"), v.alias("value")
                ),
            )

        return let(prefix_sums(f["gaps"]), lambda g: let(prefix_sums(f["lengths"]), lambda n: spans(g, n)))

    return let(found, place)


_SPAN = "array<struct<start:int,kind:int,end:int>>"


def base_spans(text: Column) -> Column:
    """start, kind (its place in ``KINDS``) and end of the base matches, by start and kind."""
    def of_kind(place: int, name: str) -> Column:
        pattern, group, least = KINDS[name]
        long = F.filter(matches(text, pattern, group), lambda m: F.char_length(m["value"]) >= least)
        spans = F.transform(
            long, lambda m: F.struct(m["start"].alias("start"), F.lit(place).alias("kind"), m["end"].alias("end"))
        )
        return F.when(text.rlike(LIKELY[name]), spans).otherwise(F.array().cast(_SPAN))

    return F.array_sort(F.concat(*[of_kind(i, name) for i, name in enumerate(KINDS)]))


def _logit(z: Column) -> Column:
    """The log odds of the normal distribution function at ``z``, to about 1e-4 of that function."""
    return 1.5976 * z + 0.07056 * z * z * z


def randomness(token: Column) -> Column:
    """Chance that an ordinary token looks as random as ``token`` does; 1 where too little of it is left to tell."""
    bare = F.regexp_replace(F.regexp_replace(token, IDS, ""), "[^A-Za-z0-9]", "")
    alphabet = (
        F.when(bare.rlike("^([0-9a-f]+|[0-9A-F]+)$"), F.lit(HEX))
        .when(bare.rlike("^[A-Z2-7]+$"), F.lit(BASE32))
        .otherwise(F.lit(BASE64))
    )
    total = lambda a: F.aggregate(a, F.lit(0.0), lambda x, y: x + y)

    def chars(known: Column) -> Column:
        return F.filter(F.split(known["spelled"], ""), lambda c: c != "")

    def described(known: Column, chars: Column) -> Column:
        at = F.transform(chars, lambda c: F.instr(known["alphabet"], c).cast("double") - 1)
        # a count is what the token loses without the symbol: a pass each over the alphabet, for tokens of any length
        lost = lambda c: F.char_length(F.replace(known["spelled"], c, F.lit("")))
        counts = F.transform(F.array_distinct(chars), lambda c: (F.size(chars) - lost(c)).cast("double"))
        return F.struct(known["alphabet"].alias("alphabet"), at.alias("x"), counts.alias("counts"))

    def score(known: Column) -> Column:
        # the mean once, not again for each symbol
        return let(total(known["x"]) / F.size(known["x"]), lambda middle: score_around(known, middle))

    def score_around(known: Column, middle: Column) -> Column:
        size = F.char_length(known["alphabet"]).cast("double")
        x = known["x"]
        n = F.size(x).cast("double")
        # chi-squared against the uniform alphabet, as the share of equal pairs
        chi2 = size / n * total(F.transform(known["counts"], lambda c: c * c)) - n
        equal = ((chi2 + n) * n / size - n) / (n * (n - 1))
        # runs of classes: 0 digits, 1 lower, 2 upper case
        group = lambda s: (
            F.when(size == 16, (s >= 10).cast("int"))
            .when(size == 32, (s < 26).cast("int"))
            .otherwise(F.when(s < 26, 2).when(s < 52, 1).otherwise(0))
        )
        steps = F.transform(x, lambda s, i: group(s) - group(F.get(x, i - 1)) * F.when(i > 0, 1))
        upper_to_lower = lambda d, i: (d == -1) & (group(F.get(x, i)) == 1)
        switches = F.size(F.filter(steps, lambda d, i: (d != 0) & ~upper_to_lower(d, i))).cast("double")
        runs = switches / (n - 1)
        # serial correlation
        power = total(F.transform(x, lambda s: (s - middle) * (s - middle)))
        lagged = total(
            F.transform(x, lambda s, i: F.when(i > 0, (s - middle) * (F.get(x, i - 1) - middle)).otherwise(0.0))
        )
        serial = F.when(power > 0, lagged / power).otherwise(1.0)
        ordinary = [
            F.when(size == 16, ORDINARY[16][k]).when(size == 32, ORDINARY[32][k]).otherwise(ORDINARY[62][k]) for k in range(3)
        ]
        away = (ordinary[0] - equal, runs - ordinary[1], ordinary[2] - serial)
        scores = [z / F.sqrt(a * a + b * b / n) for z, (a, b) in zip(away, SPREAD, strict=True)]
        bounded = [w * F.greatest(F.least(z, F.lit(8.0)), F.lit(-8.0)) for z, w in zip(scores, WEIGHTS, strict=True)]
        return 1 / (1 + F.exp(_logit((bounded[0] + bounded[1] + bounded[2]) / sum(w * w for w in WEIGHTS) ** 0.5)))

    spelled = lambda k: F.when(k["alphabet"] == HEX, F.lower(k["bare"])).otherwise(k["bare"])
    known = lambda k: F.struct(k["alphabet"].alias("alphabet"), spelled(k).alias("spelled"))
    whole = lambda k: let(chars(k), lambda c: let(described(k, c), score))
    tested = lambda k: F.when(F.char_length(k["bare"]) < LEAST_SYMBOLS, 1.0).otherwise(let(known(k), whole))
    return let(F.struct(bare.alias("bare"), alphabet.alias("alphabet")), tested)


_CANDIDATES = "array<struct<start:int,end:int,p:double>>"


def candidates(text: Column, base: Column) -> Column:
    """start, end and chance of the tokens the battery looks at: those with a letter, apart from base spans."""
    lettered = F.filter(matches(text, CANDIDATE), lambda m: m["value"].rlike("[A-Za-z]"))
    apart = F.filter(
        lettered, lambda m: ~F.exists(base, lambda b: (b["start"] < m["end"]) & (m["start"] < b["end"]))
    )
    scored = F.transform(
        apart, lambda m: F.struct(m["start"].alias("start"), m["end"].alias("end"), randomness(m["value"]).alias("p"))
    )
    return F.when(text.rlike(CANDIDATE), scored).otherwise(F.array().cast(_CANDIDATES))


def _weight(start: Column, end: Column) -> Column:
    return F.log((end - start).cast("double"))


def _weighted(c: Column, mean_weight: Column | float) -> Column:
    return c["p"] * mean_weight / _weight(c["start"], c["end"])


def discoveries(candidates: DataFrame, fdr: float = FDR) -> tuple[float, float]:
    """Mean weight and largest weighted p-value of the tokens reported (-1 if none is), over all ``candidates`` (an array a row)."""
    tokens = keep(candidates.select(F.explode(candidates.columns[0]).alias("c")).select("c.*"), "tokens")
    weight = _weight(F.col("start"), F.col("end"))
    n, mean_weight = tokens.agg(F.count("*"), F.avg(weight)).first()
    if not n:
        return 1.0, -1.0
    # equal ones as one, so that a token which every text has is one row
    weighted = tokens.groupBy((F.col("p") * mean_weight / weight).alias("q")).agg(F.count("*").alias("times"))
    ranked = running_totals(weighted, [F.col("q")], {"rank": F.col("times")})
    last = ranked.where(F.col("q") <= F.col("rank") * fdr / n).agg(F.max("q")).first()[0]
    return mean_weight, -1.0 if last is None else last


def find(
    docs: DataFrame, columns: list[str] | None = None, fdr: float = FDR, names: tuple[str, str] = ("base_spans", "spans")
) -> DataFrame:
    """Rows of ``docs`` (text and others) with base_spans and spans.

    Each span is (start, kind, end), kind the place in ``KINDS``, or 3 for
    tokens of the battery; spans are in order of start and kind. ``columns``:
    those to return, all by default. ``names``: what the two new columns are
    called; columns of these names are replaced, all others pass through.

    Null and empty texts have no spans; texts and tokens of any length are
    scanned whole. Copies get equal spans; every row counts in the
    false-discovery control. An empty table gives an empty result.
    """
    kept = [c for c in (columns or docs.columns) if c.lower() not in [n.lower() for n in names]]
    base, tokens = fresh(docs, "_base", "_candidates")
    text = F.coalesce("text", F.lit(""))
    measured = docs.withColumn(base, base_spans(text)).withColumn(tokens, candidates(text, F.col(base)))
    measured = keep(measured.select(*kept, base, tokens), "measured")
    mean_weight, last = discoveries(measured.select(tokens), fdr)
    found = F.filter(tokens, lambda c: _weighted(c, mean_weight) <= last)
    spans = F.transform(
        found, lambda c: F.struct(c["start"].alias("start"), F.lit(len(KINDS)).alias("kind"), c["end"].alias("end"))
    )
    return measured.select(*kept, F.col(base).alias(names[0]), F.array_sort(F.concat(base, spans)).alias(names[1]))


def spelled(spans: Column) -> Column:
    """kind:start:end of each span, joined by commas."""
    names = F.array(*[F.lit(k) for k in (*KINDS, RANDOM)])
    return F.array_join(
        F.transform(spans, lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"], s["end"])), ","
    )


def redact(text: Column, spans: Column, mark: str = "[secret]") -> Column:
    """``text`` with what the spans cover replaced by ``mark``; spans that overlap are one."""
    empty = F.struct(F.lit(0).alias("at"), F.array().cast("array<string>").alias("parts"))

    def step(acc: Column, s: Column) -> Column:
        gap = F.substring(text, acc["at"] + 1, s["start"] - acc["at"])
        parts = F.when(s["start"] >= acc["at"], F.concat(acc["parts"], F.array(gap, F.lit(mark)))).otherwise(acc["parts"])
        return F.struct(F.greatest(acc["at"], s["end"]).alias("at"), parts.alias("parts"))

    whole = lambda acc: F.concat(
        F.array_join(acc["parts"], ""), F.substring(text, acc["at"] + 1, F.char_length(text))
    )
    return F.when(F.size(spans) == 0, text).otherwise(F.aggregate(spans, empty, step, whole))


def op7_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secrets of all documents."""
    found = find(table(spark, sf_dir, "documents").select("doc_id", "text"), ["doc_id"])
    count = lambda kind: F.size(F.filter("base_spans", lambda s: s["kind"] == kind)).cast("long")
    return found.select(
        "doc_id",
        *[count(i).alias(f"n_{name}") for i, name in enumerate(KINDS)],
        F.sha2(spelled(F.col("base_spans")), 256).alias("base_sha256"),
        spelled(F.col("spans")).alias("spans"),
    )


QUERIES = {"op7_secrets": op7_secrets}
ORACLES: dict[str, str] = {}
