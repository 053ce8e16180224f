"""Secret scans: fixed patterns, and character Markov models for secrets that no pattern names.

Method: two models of characters in a row, one of random strings and one of ordinary identifiers, are
trained from labelled samples; a token whose log-likelihood ratio favours randomness strongly enough
is a secret. Random strings are the values that the fixed patterns find in a sample of documents, and
digests of the sample's ids in hexadecimal and base 64. Identifiers are the sample's other words, and
compounds of neighbouring words in the usual spellings (snake_case, camelCase, UPPER_CASE, paths,
with numbers), and times.

All on DataFrame functions. The models are one table of 128 x 128 numbers; after they are trained
every text is scanned whole where it is read, without any shuffle.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, functions as F

from tidemark.llm.common import text_of, unpacked, whole

KINDS = ("assign", "access", "hex", "markov")
ASSIGN = r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
# Runs that are too short never hold a longer one, so the least length can stand in the pattern.
ACCESS = r"AKIA[A-Z0-9]{12,}"
HEX = r"[0-9a-f]{32,}"
VALUE = 8  # characters of an assigned value, at least
TOKEN = r"[A-Za-z0-9+/_-]{16,}={0,2}"
SAMPLE = 4_000  # documents that the models are trained on, about
RATIO = 16.0  # natural logarithm of how much likelier a secret must be under the model of random strings
SMOOTHING = 0.5
CODES = 128

SPAN = "array<struct<start:int,kind:int,end:int>>"


def matches(text: Column, pattern: str, kind: int, group: int = 0, least: int = 0) -> Column:
    """Spans (code points, end exclusive) of the leftmost matches that do not overlap, in order.

    Places are sums over the pieces between the matches and the matches. Matches whose `group` is
    shorter than `least` are left out.
    """
    pieces = F.split(text, pattern, -1)
    whole_match = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    part = F.regexp_extract_all(text, F.lit(pattern), F.lit(group)) if group else whole_match
    sizes = F.transform(
        F.arrays_zip(pieces.alias("gap"), whole_match.alias("hit"), part.alias("part")),
        lambda x: F.struct(
            F.char_length(x.gap).alias("gap"),
            F.coalesce(F.char_length(x.hit), F.lit(0)).alias("hit"),
            F.coalesce(F.char_length(x.part), F.lit(-1)).alias("part"),
        ),
    )

    def step(state: Column, x: Column) -> Column:
        start = state.at + x.gap
        span = F.struct(start.alias("start"), F.lit(kind).alias("kind"), (start + x.hit).alias("end"))
        more = F.concat(state.out, F.array(span))
        return F.struct((start + x.hit).alias("at"), F.when((x.hit > 0) & (x.part >= least), more).otherwise(state.out).alias("out"))

    begin = F.struct(F.lit(0).alias("at"), F.array().cast(SPAN).alias("out"))
    return F.when(text.rlike(pattern), F.aggregate(sizes, begin, step, lambda s: s.out)).otherwise(F.array().cast(SPAN))


def codes(token: Column) -> Column:
    """Codes of a token's ASCII characters."""
    return F.transform(F.filter(F.split(token, "", -1), lambda c: c != ""), lambda c: F.ascii(c))


def labelled_tokens(docs: DataFrame, text: str, sample: int) -> DataFrame:
    """(label, token): 1 for random strings, 0 for identifiers, each once, from a sample of documents.

    The sample is chosen by digest of the text, so it depends on no layout; about `sample` documents.
    """
    n = max(1, docs.count())
    body = text_of(F.col(f"`{text}`"))
    chosen = docs.select(body.alias("body"), F.xxhash64(body).alias("draw")).where(
        F.pmod("draw", F.lit(1_000_000)) < F.lit(math.ceil(1e6 * min(1.0, sample / n)))
    )
    values = F.concat(
        F.regexp_extract_all("body", F.lit(ASSIGN), F.lit(2)),
        F.regexp_extract_all("body", F.lit(ACCESS), F.lit(0)),
        F.regexp_extract_all("body", F.lit(HEX), F.lit(0)),
    )
    drawn = F.md5(F.col("draw").cast("string").cast("binary"))
    long = F.sha2(F.col("draw").cast("string").cast("binary"), 256)
    made = F.array(drawn, F.regexp_replace(F.base64(F.unhex(long)), "[^A-Za-z0-9+/]", ""), F.upper(F.substring(drawn, 1, 20)))
    random = chosen.select(F.explode(F.concat(F.filter(values, lambda v: F.char_length(v) >= VALUE), made)).alias("token"))

    plain = chosen.where(~(F.col("body").rlike(ASSIGN) | F.col("body").rlike(ACCESS) | F.col("body").rlike(HEX)))
    words = F.regexp_extract_all("body", F.lit("[A-Za-z]{2,}"), F.lit(0))

    def compound(w: Column, i: Column) -> Column:
        low, after = F.lower(w), F.lower(F.col("words")[F.least(i + 1, F.size("words") - 1)])
        year = F.pmod(F.xxhash64(w), F.lit(100)).cast("string")
        two = [F.lpad(F.pmod(F.xxhash64(w, F.lit(k)), F.lit(m)).cast("string"), 2, "0") for k, m in enumerate((40, 12, 28, 24, 60))]
        time = F.concat(F.lit("20"), two[0], F.lit("-"), two[1], F.lit("-"), two[2], F.lit("T"), two[3], F.lit("-"), two[4])
        kinds = [
            w, low, F.concat_ws("_", low, after), F.concat(low, F.initcap(after)), F.concat(F.initcap(low), F.initcap(after)),
            F.upper(F.concat_ws("_", low, after)), F.concat_ws("-", low, after), F.concat(low, after, year), F.concat_ws("/", low, after, w), time,
        ]
        return F.array(*kinds)[F.pmod(i, F.lit(len(kinds)))]

    identifiers = plain.select(words.alias("words")).select(F.explode(F.transform("words", compound)).alias("token"))
    return random.withColumn("label", F.lit(1)).unionByName(identifiers.withColumn("label", F.lit(0))).distinct()


def train(docs: DataFrame, text: str = "text", sample: int = SAMPLE) -> list[float]:
    """The log-likelihood ratio of each pair of characters (128 * first + second; 0 stands before a token)."""
    tokens = labelled_tokens(docs, text, sample).select("label", codes(F.col("token")).alias("codes"))
    pair = F.zip_with(F.concat(F.array(F.lit(0)), F.col("codes")), "codes", lambda a, b: a * CODES + b)
    counted = tokens.select("label", F.explode(pair).alias("pair")).where("pair is not null").groupBy("label", "pair").count()
    counts = [[SMOOTHING] * CODES * CODES for _ in range(2)]
    for label, at, n in counted.collect():  # at most 2 * 128 * 128 rows
        if at < CODES * CODES:
            counts[label][at] += n
    ratios = []
    for first in range(CODES):
        rows = [c[first * CODES : (first + 1) * CODES] for c in counts]
        totals = [sum(r) for r in rows]
        ratios += [math.log(b / totals[1]) - math.log(a / totals[0]) for a, b in zip(*rows)]
    return ratios


def log_ratio(token: Column, table: list[float]) -> Column:
    """Log-likelihood ratio of a token under the two models."""
    ratios = F.split(F.lit(",".join(f"{x:.6g}" for x in table)), ",").cast("array<double>")  # folded to one literal
    start = F.struct(F.lit(0).alias("last"), F.lit(0.0).alias("sum"))
    step = lambda s, c: F.struct(c.alias("last"), (s.sum + ratios[s["last"] * CODES + c]).alias("sum"))
    return F.aggregate(codes(token), start, step, lambda s: s.sum)


def markov_spans(text: Column, table: list[float], base: Column) -> Column:
    """Spans of tokens that the models call random and that touch no span of `base`."""
    spans = matches(text, TOKEN, KINDS.index("markov"))
    tokens = F.when(text.rlike(TOKEN), F.regexp_extract_all(text, F.lit(TOKEN), F.lit(0))).otherwise(F.array().cast("array<string>"))
    paired = F.arrays_zip(spans.alias("span"), tokens.alias("token"))
    likely = F.filter(paired, lambda x: log_ratio(x.token, table) >= RATIO)
    free = F.filter(likely, lambda x: ~F.exists(base, lambda b: (b.start < x.span.end) & (b.end > x.span.start)))
    return F.transform(free, lambda x: x.span)


def listed(spans: Column) -> Column:
    """`kind:start:end` of each span, comma-joined."""
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", names[s.kind], s.start.cast("string"), s.end.cast("string"))), ",")


def scanned(docs: DataFrame, text: str = "text", carry: list[str] | None = None) -> DataFrame:
    """Documents with n_assign, n_access, n_hex, n_markov, base_sha256 and spans; all rows are kept.

    Base spans are the matches of the three fixed patterns; `spans` adds the tokens that the Markov
    models call random where they touch no base span. Spans are listed by start, then kind. Null
    texts are empty and have none. Without any document, or without random strings, only smoothing
    speaks, and the fixed patterns still hold. `carry` names the columns that go on (all by default).
    """
    carry = docs.columns if carry is None else carry
    table = train(docs, text)
    rows = docs.select(whole(docs.select(*[f"`{c}`" for c in carry])), text_of(F.col(f"`{text}`")).alias("body"))
    body = F.col("body")
    found = rows.select(
        "row", "body", matches(body, ASSIGN, 0, 2, VALUE).alias("assign"), matches(body, ACCESS, 1).alias("access"), matches(body, HEX, 2).alias("hex")
    )
    found = found.withColumn("base", F.array_sort(F.concat("assign", "access", "hex")))
    found = found.withColumn("markov", markov_spans(body, table, F.col("base"))).drop("body")
    every = F.when(F.size("markov") > 0, F.array_sort(F.concat("base", "markov"))).otherwise(F.col("base"))
    return unpacked(
        found,
        carry,
        n_assign=F.size("assign").cast("long"),
        n_access=F.size("access").cast("long"),
        n_hex=F.size("hex").cast("long"),
        n_markov=F.size("markov").cast("long"),
        base_sha256=F.sha2(listed(F.col("base")).cast("binary"), 256),
        spans=listed(every),
    )
