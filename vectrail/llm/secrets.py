"""Secret scans: fixed patterns and a battery of randomness tests (DataFrame functions only).

Pattern spans are leftmost and non-overlapping for each kind. Besides them, every run of 20 or more
characters of A-Z a-z 0-9 and + / or _ - is tested in the encoding that its characters imply: letters
of one case, base 16, 32, 36, 62, 64 or URL-safe 64. Two questions are asked of a run of n characters:

* Can it be ordinary text? Letters of a language coincide more often than random ones, so that
  chi-squared about uniformity is noncentral with n * (k * coincidence - 1), and digits, capitals and
  small letters come in groups, so that neighbours differ in class in ``changes`` of all places only.
  The scores of both, the latter where an encoding has classes, are added (Stouffer) to a p-value.
* Can it be random? Chi-squared, Wald-Wolfowitz runs about the alphabet's middle and lag-1 serial
  correlation are tested under uniformity; the smallest p-value, times the number of tests, has to
  reach ``alpha``. Counting and keyboard orders, though uniform, fail here.

Reported, as kind ``random``, are the runs that can't be ordinary by a Benjamini-Hochberg step over
the p-values of the text's runs at rate ``rate``, and can be random. So the share of ordinary runs
among the reported is what is controlled; as the noncentrality and the spread of changes follow the
length, a long run needs as little luck to be told as its evidence allows, and the share of random
runs that is found grows with length. Runs that are wholly a hex or access span are left out. A run of
all three kinds of symbols is cut at + and /, or else at _ and -.

Scale: one pass over the texts, no shuffle, no Python. Texts without a match, nearly all, cost one
search a pattern; starts come from running sums in blocks, so a text of n spans costs n^1.5.

Defined results: a null text is empty and has no spans; repeated rows are each scanned; an empty
table gives no rows. Places are code points, ends exclusive. Other columns are kept by ``redact``
and left out by ``scan``, whatever their names.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vectrail.llm.common import LOWER, UPPER, let, running, running_starts

#: Patterns. Fixed values. The keyword's letters match in either case, ASCII only.
ASSIGN = r"""((?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?)([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{14,}"
HEX = r"[0-9a-f]{16,}"
RUN = (
    r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/]{20,}+(?![_-])"
    r"|(?<![A-Za-z0-9_-])[A-Za-z0-9_-]{20,}+"
    r"|(?<![A-Za-z0-9+/])[A-Za-z0-9+/]{20,}+"
)
ASSIGN_LEAST = 12
KINDS = ("assign", "access", "hex", "random")
DIGITS = "0123456789"


class Encoding(NamedTuple):
    """An alphabet in order of its classes, which begin at ``cuts``, and what ordinary text in it
    is like: how often two of its characters coincide, and neighbours differ in class."""

    pattern: str
    alphabet: str
    cuts: tuple[int, ...] = ()
    coincidence: float = 0.06
    changes: float = 0.25


#: The first that fits the whole run.
ENCODINGS = (
    Encoding(r"^[a-z]+$", LOWER),
    Encoding(r"^[A-Z]+$", UPPER),
    Encoding(r"^[A-F0-9]+$", DIGITS + UPPER[:6], (10,), 0.1),
    Encoding(r"^[A-Z2-7]+$", UPPER + "234567", (26,), 0.06, 0.2),
    Encoding(r"^[a-z0-9]+$", DIGITS + LOWER, (10,)),
    Encoding(r"^[A-Z0-9]+$", DIGITS + UPPER, (10,)),
    Encoding(r"^[A-Za-z0-9]+$", DIGITS + UPPER + LOWER, (10, 36), 0.05, 0.3),
    Encoding(r"^[A-Za-z0-9+/]+$", UPPER + LOWER + DIGITS + "+/", (26, 52, 62), 0.05, 0.3),
    Encoding(r"^[A-Za-z0-9_-]+$", UPPER + LOWER + DIGITS + "-_", (26, 52, 62), 0.05, 0.3),
)


def _upper_tail(z: Column) -> Column:
    """P(N(0, 1) > z), Abramowitz and Stegun 26.2.17."""

    def half(x: Column) -> Column:
        t = 1 / (1 + 0.2316419 * x)
        poly = t * (0.319381530 + t * (-0.356563782 + t * (1.781477937 + t * (-1.821255978 + t * 1.330274429))))
        return F.exp(-x * x / 2) / math.sqrt(2 * math.pi) * poly

    return let(half(F.abs(z)), lambda p: F.when(z >= 0, p).otherwise(1 - p))


def _two_sided(z: Column) -> Column:
    return 2 * _upper_tail(F.abs(z))


def _chi2(run: Column, n: Column, alphabet: Column) -> Column:
    squares = F.aggregate(F.split(alphabet, ""), F.lit(0.0), lambda acc, c: acc + F.pow(n - F.length(F.replace(run, c, F.lit(""))), F.lit(2.0)))
    return F.greatest(squares * F.length(alphabet) / n - n, F.lit(0.0))


def _uniform(x: Column, k: Column) -> Column:
    """P(chi-squared > x) under uniformity, by Wilson and Hilferty."""
    spread = 2 / (9 * (k - 1))
    return _upper_tail((F.pow(x / (k - 1), F.lit(1 / 3)) - (1 - spread)) / F.sqrt(spread))


def _total(xs: Column, f: Callable[[Column], Column]) -> Column:
    return F.aggregate(xs, F.lit(0.0), lambda acc, x: acc + f(x))


def _runs(places: Column, n: Column, k: Column) -> Column:
    """Runs above and below the middle of the alphabet."""

    def test(s: Column) -> Column:
        high, low, runs = s["high"], n - s["high"], s["changes"] + 1
        mean = 2 * high * low / n + 1
        var = (mean - 1) * (mean - 2) / (n - 1)
        return F.when((high == 0) | (low == 0) | (var <= 0), F.lit(0.0)).otherwise(_two_sided((runs - mean) / F.sqrt(var)))

    half = k / 2
    changes = F.zip_with(
        F.slice(places, 1, (n - 1).cast("int")),
        F.slice(places, 2, (n - 1).cast("int")),
        lambda a, b: F.when((a >= half) != (b >= half), 1.0).otherwise(0.0),
    )
    high = _total(places, lambda x: F.when(x >= half, 1.0).otherwise(0.0))
    return let(F.struct(high.alias("high"), _total(changes, lambda x: x).alias("changes")), test)


def _serial(places: Column, n: Column) -> Column:
    def test(s: Column) -> Column:
        pairs = F.zip_with(
            F.slice(places, 1, (n - 1).cast("int")),
            F.slice(places, 2, (n - 1).cast("int")),
            lambda a, b: (a - s) * (b - s),
        )
        spread = _total(places, lambda x: (x - s) * (x - s))
        return let(
            F.struct(spread.alias("d"), _total(pairs, lambda x: x).alias("c")),
            lambda x: F.when(x["d"] == 0, F.lit(0.0)).otherwise(_two_sided((x["c"] / x["d"] + 1 / n) * F.sqrt(n))),
        )

    return let(_total(places, lambda x: x) / n, test)


def _ordinary(x: Column, places: Column, n: Column, k: Column, e: Column) -> Column:
    """How likely ordinary text is as uniform, and changes class as often."""
    more = n * (k * e["coincidence"] - 1)
    score = (k - 1 + more - x) / F.sqrt(2 * (k - 1 + 2 * more))

    def changed(kinds: Column) -> Column:
        near = F.zip_with(F.slice(kinds, 1, (n - 1).cast("int")), F.slice(kinds, 2, (n - 1).cast("int")), lambda a, b: F.when(a != b, 1.0).otherwise(0.0))
        return (_total(near, lambda c: c) - (n - 1) * e["changes"]) / F.sqrt((n - 1) * e["changes"] * (1 - e["changes"]))

    kinds = F.transform(places, lambda p: F.size(F.filter(e["cuts"], lambda c: c <= p)))
    return _upper_tail(F.when(F.size(e["cuts"]) == 0, score).otherwise((score + let(kinds, changed)) / math.sqrt(2)))


def _encoding(run: Column) -> Column:
    """The first encoding that fits, as a struct, or null."""
    found = F.lit(None)
    for e in reversed(ENCODINGS):
        cuts = F.array(*[F.lit(float(c)) for c in e.cuts]).cast("array<double>")
        own = F.struct(F.lit(e.alphabet).alias("alphabet"), cuts.alias("cuts"), F.lit(e.coincidence).alias("coincidence"), F.lit(e.changes).alias("changes"))
        found = F.when(run.rlike(e.pattern), own).otherwise(found)
    return found


def battery(run: Column) -> Column:
    """struct<ordinary, random>: the p-values of the two questions. A run that is a hex or access
    span, or in no one encoding, is ordinary."""
    n = F.length(run).cast("double")

    def tested(e: Column) -> Column:
        k = F.length(e["alphabet"]).cast("double")
        places = F.transform(F.split(run, ""), lambda c: (F.instr(e["alphabet"], c) - 1).cast("double"))

        def both(s: Column) -> Column:
            random = F.least(_uniform(s["x"], k), _runs(s["places"], n, k), _serial(s["places"], n)) * 3
            return F.struct(_ordinary(s["x"], s["places"], n, k, e).alias("ordinary"), random.alias("random"))

        return let(F.struct(places.alias("places"), _chi2(run, n, e["alphabet"]).alias("x")), both)

    none = F.struct(F.lit(1.0).alias("ordinary"), F.lit(0.0).alias("random"))
    found = let(_encoding(run), lambda e: F.when(e.isNull(), none).otherwise(tested(e)))
    return F.when(run.rlike(rf"^({HEX}|{ACCESS})$"), none).otherwise(found)


def _reported(runs: Column, rate: float, alpha: float) -> Column:
    """For each run whether Benjamini-Hochberg rejects that it is ordinary, and it can be random."""

    def judge(tests: Column) -> Column:
        ordered = F.array_sort(F.transform(tests, lambda t: t["ordinary"]))
        passed = F.transform(ordered, lambda p, i: F.when(p <= F.lit(rate) * (i + 1) / F.size(tests), p).otherwise(F.lit(-1.0)))
        return let(F.array_max(passed), lambda most: F.transform(tests, lambda t: (t["ordinary"] <= most) & (t["random"] >= alpha)))

    return F.when(F.size(runs) == 0, F.array().cast("array<boolean>")).otherwise(let(F.transform(runs, battery), judge))


def _spans(text: Column, pattern: str, kind: str, matches: Column, keep: Column | None, tails: Column | None = None) -> Column:
    """array<struct<start, rank, end>> of the kept matches, or of the ``tails`` they end with."""
    empty = F.array().cast("array<struct<start:bigint,rank:int,end:bigint>>")
    rank = KINDS.index(kind)

    def placed(pieces: Column) -> Column:
        lengths = F.zip_with(
            F.slice(pieces, 1, F.size(matches)), matches, lambda p, m: (F.length(p) + F.length(m)).cast("long")
        )
        found = F.zip_with(
            F.slice(running_starts(lengths), 2, F.size(matches)),
            matches if tails is None else tails,
            lambda end, m: F.struct((end - F.length(m)).alias("start"), F.lit(rank).alias("rank"), end.alias("end")),
        )
        if keep is None:
            return found
        both = F.zip_with(found, keep, lambda s, k: F.struct(s.alias("s"), k.alias("k")))
        return F.transform(F.filter(both, lambda b: b["k"]), lambda b: b["s"])

    return F.when(F.size(matches) > 0, let(F.split(text, pattern), placed)).otherwise(empty)


def _spanned(rows: DataFrame, rate: float, alpha: float, values_only: bool = False) -> DataFrame:
    """``rows`` with _spans of their _text, sorted by start and kind. If ``values_only``, an
    assignment's span is its value."""
    t = F.col("_text")
    patterns = {"_assign": ASSIGN, "_access": ACCESS, "_hex": HEX, "_runs": RUN}
    found = {name: F.regexp_extract_all(t, F.lit(pattern), F.lit(0)) for name, pattern in patterns.items()}
    found["_values"] = F.regexp_extract_all(t, F.lit(ASSIGN), F.lit(2))
    long_enough = F.transform("_values", lambda v: F.length(v) >= ASSIGN_LEAST)
    random = _reported(F.col("_runs"), rate, alpha)
    spans = F.concat(
        _spans(t, ASSIGN, "assign", F.col("_assign"), long_enough, F.col("_values") if values_only else None),
        _spans(t, ACCESS, "access", F.col("_access"), None),
        _spans(t, HEX, "hex", F.col("_hex"), None),
        _spans(t, RUN, "random", F.col("_runs"), random),
    )
    return rows.withColumns(found).select(*rows.columns, F.array_sort(spans).alias("_spans"))


def scan(
    df: DataFrame, *, keys: Sequence[str], text: str = "text", rate: float = 0.02, alpha: float = 0.001
) -> DataFrame:
    """``keys`` and spans, array<struct<start, rank, end>> sorted by start and kind; rank is the
    place in KINDS."""
    own = [F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)]
    rows = _spanned(df.select(*own, F.coalesce(F.col(text), F.lit("")).alias("_text")), rate, alpha)
    return rows.select(*[F.col(f"_k{i}").alias(k) for i, k in enumerate(keys)], F.col("_spans").alias("spans"))


def _joined(spans: Column) -> Column:
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(
        F.transform(spans, lambda s: F.concat_ws(":", F.element_at(names, s["rank"] + 1), s["start"].cast("string"), s["end"].cast("string"))), ","
    )


def digests(spans: DataFrame, *, key: str) -> DataFrame:
    def count(kind: str) -> Column:
        return F.size(F.filter("spans", lambda s: s["rank"] == KINDS.index(kind))).cast("long").alias(f"n_{kind}")

    base = F.filter("spans", lambda s: s["rank"] < KINDS.index("random"))
    return spans.select(
        key, *[count(k) for k in KINDS[:3]], F.sha2(_joined(base), 256).alias("base_sha256"), _joined(F.col("spans")).alias("spans")
    )


def _masked(text: Column, spans: Column, mask: str) -> Column:
    """``text`` with each group of overlapping spans replaced by one mask. The text is cut in
    blocks of about sqrt(n) spans first, so that no cut walks all of a long text."""

    def cut(t: Column, start: Column, end: Column) -> Column:
        return F.substring(t, (start + 1).cast("int"), F.greatest(end - start, F.lit(0)).cast("int"))

    def rebuilt(s: Column) -> Column:
        # Each span with how far the spans before it reach.
        return let(
            F.struct(
                F.zip_with(
                    s,
                    F.slice(running(F.transform(s, lambda x: x["end"]), lambda a, b: F.greatest(a, b)), 1, F.size(s)),
                    lambda x, before: F.struct(before.alias("before"), x["start"].alias("start")),
                ).alias("gaps"),
                F.array_max(F.transform(s, lambda x: x["end"])).alias("last"),
                F.ceil(F.sqrt(F.size(s))).cast("int").alias("block"),
            ),
            blocks,
        )

    def blocks(x: Column) -> Column:
        firsts = F.sequence(F.lit(1), F.size(x["gaps"]), x["block"])

        def one(first: Column) -> Column:
            own = F.slice(x["gaps"], first, x["block"])
            base = F.element_at(own, 1)["before"]
            until = F.coalesce(F.get(x["gaps"], first - 1 + x["block"])["before"], x["last"])
            piece = lambda part: F.transform(
                own,
                lambda g: F.when(g["start"] < g["before"], F.lit("")).otherwise(
                    F.concat(cut(part, g["before"] - base, g["start"] - base), F.lit(mask))
                ),
            )
            return let(cut(text, base, until), lambda part: F.array_join(piece(part), ""))

        return F.concat(F.array_join(F.transform(firsts, one), ""), cut(text, x["last"], F.length(text).cast("long")))

    return F.when(F.size(spans) > 0, let(spans, rebuilt)).otherwise(text)


def redact(df: DataFrame, *, text: str = "text", mask: str = "[SECRET]", rate: float = 0.02, alpha: float = 0.001) -> DataFrame:
    """``df`` with the spans that ``scan`` finds masked; of an assignment, its value. Spans that
    overlap get one mask. A null text stays."""
    own = [F.col(f"`{c}`").alias(f"_c{i}") for i, c in enumerate(df.columns)]
    rows = _spanned(df.select(*own, F.coalesce(F.col(f"`{text}`"), F.lit("")).alias("_text")), rate, alpha, values_only=True)
    new = F.when(F.col(f"_c{df.columns.index(text)}").isNotNull(), _masked(F.col("_text"), F.col("_spans"), mask))
    return rows.select(*[(new if c == text else F.col(f"_c{i}")).alias(c) for i, c in enumerate(df.columns)])


ORACLE = rf"""
select doc_id,
  len(list_filter(regexp_extract_all(coalesce(text, ''), '{ASSIGN.replace("'", "''")}', 2), lambda v: length(v) >= {ASSIGN_LEAST})) as n_assign,
  len(regexp_extract_all(coalesce(text, ''), '{ACCESS}')) as n_access, len(regexp_extract_all(coalesce(text, ''), '{HEX}')) as n_hex
from documents
"""
