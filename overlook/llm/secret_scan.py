"""Secret scans in DataFrame functions only: three base patterns and a battery of randomness tests.

Base spans (leftmost, non-overlapping per kind; failing matches are consumed and dropped):
assign  a name such as `api_key`, then `:` or `=`, then a value of 8 characters or more
access  AKIA and capitals or digits, 16 characters or more
hex     32 or more lowercase hex digits

Added spans (kind random): maximal runs of 20 or more letters, digits, + and /, and such runs with - and _
instead (a token behind a path is a run of its own), that hold a letter and a digit and touch no base span;
of those found, one that lies inside another isn't listed. The encoding is inferred as the smallest alphabet that holds the run
(hex, base 32, base 36, base 62, base 64), which must carry 80 bits or more at that length. Under the
hypothesis of uniform random characters the run gets four p values: chi-squared over four equal parts
of the alphabet and over its character classes, Wald-Wolfowitz runs about the alphabet's middle, and
lag-one serial correlation; four times the least of them is the combined value. Longer runs have more power, so the value is divided by a
weight in proportion to length (mean 1 over the corpus), and Benjamini-Hochberg over the counts of all
runs in the corpus finds those that are not random at a false discovery rate of `fdr`; the others are
reported. The step-up rule reads a histogram of at most BINS rows, whatever the input's size.

Offsets count code points, ends are exclusive.

Edge cases: null and empty texts have no spans; rows are independent, so ties and repeated rows give
equal results; empty tables give empty results; extra columns stay in `redact` and are ignored by `scan`.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import boxed, materialize, new_text, table, unboxed

#: Fixed patterns.
ASSIGN = r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{12,}"
HEX = r"(?<![0-9a-f])[0-9a-f]{32,}+"
RUN = r"(?<![A-Za-z0-9+/])[A-Za-z0-9+/]{20,}+"
SLUG = r"(?<![A-Za-z0-9_-])[A-Za-z0-9_-]{20,}+"

KINDS = ("assign", "access", "hex", "random")
#: Alphabets in code order, by what matches them.
DIGITS, UPPER, LOWER = "0123456789", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
ENCODINGS = (
    ("^[0-9a-f]+$", "0123456789abcdef"),
    ("^[0-9A-F]+$", "0123456789ABCDEF"),
    ("^[A-Z2-7]+$", UPPER + "234567"),
    ("^[0-9a-z]+$", DIGITS + LOWER),
    ("^[0-9A-Z]+$", DIGITS + UPPER),
    ("^[0-9A-Za-z]+$", DIGITS + UPPER + LOWER),
    ("^[0-9A-Za-z+/]+$", UPPER + LOWER + DIGITS + "+/"),
    ("^[0-9A-Za-z_-]+$", UPPER + LOWER + DIGITS + "-_"),
)
MIN_BITS = 80
FDR = 0.01
#: Matches of a text that are gathered before the array of all grows.
STRIDE = 256
#: Histogram of -8 log2(weighted p value).
BINS = 512
MARK = "[SECRET]"


def _quoted(s: str) -> str:
    return "'" + s.replace("\\", "\\\\").replace("'", "\\'") + "'"


def _folded(items: str, emit: str, then: str, kind: str, last: str) -> str:
    """SQL: what each item x emits given `pos`, and `pos` after it, as one array of kind; `last` maps the final struct f of (pos, all).

    Arrays grow by STRIDE items at a time, so that many matches in one text don't copy what came before for each of them.
    """
    inner = f"""aggregate(slice({items}, c * {STRIDE} + 1, {STRIDE}), cast(struct(a.pos, array()) as struct<pos: bigint, all: array<{kind}>>),
        (b, x) -> struct({then.format(pos='b.pos')} as pos, concat(b.all, array({emit.format(pos='b.pos')})) as all))"""
    return f"""aggregate(sequence(0, greatest(size({items}) - 1, 0) div {STRIDE}), cast(struct(0L, array()) as struct<pos: bigint, all: array<array<{kind}>>>),
        (a, c) -> transform(array({inner}), i -> struct(i.pos as pos, concat(a.all, array(i.all)) as all))[0],
        f -> {last})"""


def _located(pieces: str, matches: str, values: str) -> str:
    """SQL: array of (s, e, t) from the texts between matches, the matches, and what to keep of each."""
    items = f"transform({matches}, (m, i) -> struct({pieces}[i] as p, m as m, {values}[i] as v))"
    start = "{pos} + length(x.p)"
    return _folded(items, f"struct({start} as s, {start} + length(x.m) as e, x.v as t)", f"{start} + length(x.m)", "struct<s: bigint, e: bigint, t: string>", "flatten(f.all)")


def _tail(z: str) -> str:
    """SQL: both tails of the normal law beyond z (Abramowitz and Stegun 7.1.26)."""
    x = f"(abs({z}) / sqrt(2))"
    t = f"(1 / (1 + 0.3275911 * {x}))"
    return f"greatest(1e-30D, {t} * (0.254829592 + {t} * (-0.284496736 + {t} * (1.421413741 + {t} * (-1.453152027 + {t} * 1.061405429)))) * exp(-{x} * {x}))"


def _classes(text: str) -> str:
    """SQL: how many characters of each class there are."""
    return "array(" + ", ".join(f"length(regexp_replace({text}, '[^{c}]', ''))" for c in ("0-9", "A-Z", "a-z", "+/_-")) + ")"


def _chi(observed: str, shares: str, n: str) -> str:
    return f"aggregate(filter(zip_with({observed}, {shares}, (o, w) -> if(w > 0, (o - {n} * w) * (o - {n} * w) / ({n} * w), 0D)), d -> d is not null), 0D, (a, d) -> a + d)"


def _chi_tail(chi: str, degrees: str) -> str:
    """SQL: upper tail of a chi-squared value, made normal by Wilson and Hilferty."""
    z = f"((pow({chi} / {degrees}, 1D / 3) - (1 - 2D / (9 * {degrees}))) / sqrt(2D / (9 * {degrees})))"
    return f"if({z} <= 0, 1D, {_tail(z)} / 2)"


def with_spans(docs: DataFrame) -> DataFrame:
    """docs with __text, __base (array of s, k, e) and __runs (array of s, e, n, p), each computed on the whole text."""
    rows = docs.withColumn("__text", F.coalesce(F.col("text").cast("string"), F.lit("")))
    for name, pattern, group in (("assign", ASSIGN, 2), ("access", ACCESS, 0), ("hex", HEX, 0), ("run", RUN, 0), ("slug", SLUG, 0)):
        there = F.col("__text").rlike(pattern)
        none = F.expr("cast(array() as array<string>)")
        rows = rows.withColumn(
            f"__{name}",
            F.when(there, F.struct(F.split("__text", pattern, -1).alias("p"), F.regexp_extract_all("__text", F.lit(pattern), F.lit(0)).alias("m"), F.regexp_extract_all("__text", F.lit(pattern), F.lit(group)).alias("v"))).otherwise(
                F.struct(none.alias("p"), none.alias("m"), none.alias("v"))
            ),
        )
    for name in ("assign", "access", "hex", "run", "slug"):
        rows = rows.withColumn(f"__{name}", F.expr(_located(f"__{name}.p", f"__{name}.m", f"__{name}.v")))
    rows = rows.withColumn("__run", F.array_sort(F.concat("__run", "__slug"))).withColumn("__run", F.expr("filter(__run, (x, i) -> i = 0 or not (x <=> __run[i - 1]))"))
    base = ", ".join(f"transform({f'filter(__{n}, x -> length(x.t) >= 8)' if n == 'assign' else f'__{n}'}, x -> struct(x.s as s, {k} as k, x.e as e))" for k, n in enumerate(KINDS[:3]))
    rows = rows.withColumn("__base", F.expr(f"array_sort(concat({base}))"))
    # runs by their ends among base spans by their starts: pos is the furthest end of those that start before a run's end
    rows = rows.withColumn("__both", F.expr("array_sort(concat(transform(__run, x -> struct(x.e as at, 0 as k, x.s as s, x.e as e, x.t as t)), transform(__base, x -> struct(x.s as at, 1 as k, x.s as s, x.e as e, '' as t))))"))
    beside = _folded("__both", "struct(x.s as s, x.e as e, x.t as t, x.k = 0 and {pos} <= x.s as free)", "if(x.k = 1, greatest({pos}, x.e), {pos})", "struct<s: bigint, e: bigint, t: string, free: boolean>", "transform(filter(flatten(f.all), x -> x.free), x -> struct(x.s as s, x.e as e, x.t as t))")
    rows = rows.withColumn("__run", F.expr(f"if(size(__base) = 0 or size(__run) = 0, __run, {beside})"))
    apart = "filter(__run, x -> x.t rlike '[0-9]' and x.t rlike '[A-Za-z]')"
    alphabet = "case " + " ".join(f"when x.t rlike {_quoted(pattern)} then {_quoted(letters)}" for pattern, letters in ENCODINGS) + " end"
    # one lambda step per line: alphabet; codes; sums; p values
    staged = f"transform({apart}, x -> struct(x.s, x.e, x.t, {alphabet} as abc))"
    staged = f"filter({staged}, x -> x.abc is not null and length(x.t) * log2(length(x.abc)) >= {MIN_BITS})"
    staged = f"transform({staged}, x -> struct(x.s, x.e, length(x.t) as n, length(x.abc) as k, {_classes('x.t')} as o2, {_classes('x.abc')} as k2, transform(filter(split(x.t, ''), c -> c != ''), c -> instr(x.abc, c) - 1) as c))"
    staged = f"""transform({staged}, x -> struct(x.s, x.e, x.n, x.k, x.o2, transform(x.k2, c -> c / x.k) as w2,
        transform(sequence(0, 3), j -> size(filter(x.c, c -> c * 4 div x.k = j))) as o,
        transform(sequence(0, 3), j -> size(filter(sequence(0, x.k - 1), c -> c * 4 div x.k = j)) / x.k) as w,
        size(filter(x.c, c -> 2 * c >= x.k)) as up,
        1 + size(filter(zip_with(slice(x.c, 1, x.n - 1), slice(x.c, 2, x.n - 1), (a, b) -> (2 * a >= x.k) != (2 * b >= x.k)), d -> d)) as r,
        aggregate(x.c, 0D, (a, c) -> a + c) as s1, aggregate(x.c, 0D, (a, c) -> a + c * c) as s2,
        aggregate(zip_with(slice(x.c, 1, x.n - 1), slice(x.c, 2, x.n - 1), (a, b) -> a * b), 0D, (a, d) -> a + d) as s11))"""
    staged = f"""transform({staged}, x -> struct(x.s, x.e, x.n,
        {_chi('x.o', 'x.w', 'x.n')} as chi, {_chi('x.o2', 'x.w2', 'x.n')} as chi2, size(filter(x.w2, w -> w > 0)) - 1 as df,
        2D * x.up * (x.n - x.up) / x.n as mu, x.r as r,
        if(x.n * x.s2 - x.s1 * x.s1 <= 0, 1D, (x.n * x.s11 - x.s1 * x.s1) / (x.n * x.s2 - x.s1 * x.s1)) as rho))"""
    runs_z = "if(x.mu <= 0, 9D, (x.r - 1 - x.mu) / sqrt(greatest(1e-9D, x.mu * (x.mu - 1) / (x.n - 1))))"
    rho_z = "(x.rho * sqrt(x.n) + 1 / sqrt(x.n))"
    p = f"least(1D, 4 * least({_chi_tail('x.chi', '3')}, {_chi_tail('x.chi2', 'x.df')}, {_tail(runs_z)}, {_tail(rho_z)}))"
    staged = f"transform({staged}, x -> struct(x.s as s, x.e as e, cast(x.n as bigint) as n, {p} as p))"
    rows = rows.withColumn("__runs", F.expr(f"if(size(__run) = 0, cast(array() as array<struct<s: bigint, e: bigint, n: bigint, p: double>>), {staged})"))
    return rows.drop("__assign", "__access", "__hex", "__run", "__slug", "__both")


def fitted(rows: DataFrame, fdr: float = FDR) -> tuple[float, int]:
    """(mean length of the corpus's runs, bin of the weighted p value from which a run is not random). Two numbers, from one histogram."""
    runs = rows.select(F.explode("__runs").alias("x")).select("x.n", "x.p")
    mean = runs.agg(F.avg("n").alias("mean")).first()["mean"] or 1.0
    counts = runs.groupBy(_bin(F.col("p"), F.col("n"), mean).alias("bin")).agg(F.count("*").alias("count")).collect()  # BINS rows at most
    by = {r["bin"]: r["count"] for r in counts}
    total, seen, cut = sum(by.values()), 0, BINS + 1
    for b in sorted(by, reverse=True):
        seen += by[b]
        if 2.0 ** (-b / 8) * total <= fdr * seen:
            cut = b
    return float(mean), int(cut)


def _bin(p, n, mean: float):
    return F.least(F.lit(BINS), F.greatest(F.lit(0), F.floor(-8 * F.log2(p * F.lit(mean) / n)))).cast("int")


def all_spans(rows: DataFrame, mean: float, cut: int) -> DataFrame:
    """rows with __spans: base spans and the runs that stay random and lie in no other such run, by start and kind."""
    kept = F.filter("__runs", lambda x: _bin(x["p"], x["n"], mean) < cut)
    rows = rows.withColumn("__more", F.array_sort(F.transform(kept, lambda x: F.struct(x["s"].alias("s"), (-x["e"]).alias("less")))))
    # of equal starts the longest comes first; pos is the furthest end so far
    outer = _folded("__more", "struct(x.s as s, -x.less as e, {pos} >= -x.less as inside)", "greatest({pos}, -x.less)", "struct<s: bigint, e: bigint, inside: boolean>", "transform(filter(flatten(f.all), x -> not x.inside), x -> struct(x.s as s, 3 as k, x.e as e))")
    plain = "transform(__more, x -> struct(x.s as s, 3 as k, -x.less as e))"
    return rows.withColumn("__spans", F.expr(f"array_sort(concat(__base, if(size(__more) > 1, {outer}, {plain})))")).drop("__more")


def _joined(column: str):
    names = F.array(*(F.lit(k) for k in KINDS))
    return F.array_join(F.transform(column, lambda x: F.concat_ws(":", F.get(names, x["k"]), x["s"].cast("string"), x["e"].cast("string"))), ",")


def scan(docs: DataFrame, fdr: float = FDR) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256, spans of every row.

    The text is read once; the spans, which are few, are written to the shared folder and give the
    corpus's histogram and then the result.
    """
    rows = materialize(with_spans(docs).select("doc_id", "__base", "__runs"), "secrets")
    out = all_spans(rows, *fitted(rows, fdr))
    counts = [F.expr(f"cast(size(filter(__base, x -> x.k = {k})) as bigint)").alias(f"n_{name}") for k, name in enumerate(KINDS[:3])]
    return out.select("doc_id", *counts, F.sha2(_joined("__base"), 256).alias("base_sha256"), _joined("__spans").alias("spans"))


def redact(docs: DataFrame, fdr: float = FDR) -> DataFrame:
    """docs with every span of text replaced by a mark (n_chars follows, if there); other texts, and all other columns whatever their names, stay as they are."""
    # one pass finds all texts' runs and is written beside the rows; the cut is known from the runs alone
    rows = materialize(with_spans(boxed(docs, F.col("text"))).select("row", "__base", "__runs"), "runs")
    rows = all_spans(rows.withColumn("__text", F.coalesce(F.col("row")["text"].cast("string"), F.lit(""))), *fitted(rows.select("__runs"), fdr))
    skip = "if(x.s < {pos}, '', concat(substring(__text, cast({pos} + 1 as int), cast(x.s - {pos} as int)), '" + MARK + "'))"
    clean = F.expr(_folded("__spans", skip, "greatest({pos}, x.e)", "string", "concat(array_join(flatten(f.all), ''), substring(__text, cast(f.pos + 1 as int)))"))
    rows = rows.withColumn("__clean", F.when(F.size("__spans") > 0, clean))
    return unboxed(rows, docs, new_text(F.col("__clean"), docs))


def query(spark, sf_dir: str) -> DataFrame:
    return scan(table(spark, sf_dir, "documents"))
