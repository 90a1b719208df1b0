"""Secret scans: fixed patterns, and character Markov models compared by log-likelihood ratio. DataFrame operations only.

The patterns' spans are the base. The models add spans: runs of 20 or more token characters that overlap no base span
and are likelier under the model of random strings than under that of ordinary identifiers. Both models are bigram
tables over a fixed alphabet, trained by an aggregate over labelled samples; the samples' size is a parameter and the
tables' size is the alphabet's square.

Texts of any length are scanned whole, in time that grows with their length. Offsets are code points, ends exclusive. A NULL text is empty; empty texts have no spans; rows repeat as they come; a
NULL doc_id stays NULL; an empty table gives an empty result; further columns are ignored.
"""
from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

# The base patterns, the least lengths and the kinds' order.
ASSIGN = r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{16,}"  # a shorter run fails from each of its starts, as AKIA[A-Z0-9]+ dropped below 20 does
HEX = r"[0-9a-f]{24,}"
KINDS = ("assign", "access", "hex", "markov")
ASSIGN_LEAST = 6

TOKEN = r"[A-Za-z0-9+/_=-]{20,}"
ALPHABET = "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789+/_=-"
#: Labelled samples of each class, and nats by which the random model must win, in all and per bigram.
SAMPLES, LEAST_TOTAL, LEAST_MEAN = 4000, 12.0, 0.35
# Words of ordinary identifiers, as text.
IDENTIFIER_WORDS = ("get set is has make build read write open close load save parse format index table column row key value name type size count list map "
                    "set node tree graph path file line word text byte char string number float double date time user account order item price total "
                    "request response server client session config option error result state event handler listener manager factory service "
                    "controller model view test check find search sort filter join merge split group update insert delete create remove "
                    "the and of that with from this for was are than their which would other about into only over after before between through "
                    "ein der die und ist nicht mit auf für sich von zum heit keit ung lich sch une les des que pas pour dans ment tion elle eau "
                    "los las del por una para como más ción mente ado ando").split()

SPANS = "array<struct<start:int,kind:int,end:int>>"


def _cut(text: Column, pattern: str, kind: int, keep=None, group: int = 0) -> Column:
    """Spans of the pattern's matches: what lies between the matches gives their places."""
    between, whole = F.split(text, pattern, -1), F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    sizes = F.transform(whole, lambda m: F.char_length(m))
    kept = F.transform(F.regexp_extract_all(text, F.lit(pattern), F.lit(group)), lambda m: keep(m)) if keep is not None else None
    pairs = F.zip_with(F.slice(F.transform(between, lambda p: F.char_length(p)), F.lit(1), F.size(sizes)), sizes, lambda p, m: F.struct(p.alias("gap"), m.alias("len")))
    none = F.lit(None).cast(SPANS)
    zero = F.struct(F.lit(0).alias("at"), F.array().cast(SPANS).alias("spans"))
    step = lambda a, x: F.struct((a["at"] + x["gap"] + x["len"]).alias("at"), F.concat(a["spans"], F.array(F.struct((a["at"] + x["gap"]).alias("start"), F.lit(kind).alias("kind"), (a["at"] + x["gap"] + x["len"]).alias("end")))).alias("spans"))
    spans = F.aggregate(pairs, zero, step)["spans"]
    if kept is not None:
        spans = F.transform(F.filter(F.arrays_zip(spans.alias("s"), kept.alias("k")), lambda z: z["k"]), lambda z: z["s"])
    return F.coalesce(spans, none)


def samples(spark: SparkSession, n: int = SAMPLES) -> DataFrame:
    """(label, s): `n` random strings in hex, base-64 and alphanumeric alphabets, `n` identifiers in the common styles."""
    ids = spark.range(n)
    seed = F.sha2(F.concat(F.lit("sample-"), F.col("id").cast("string")), 256)
    b64 = F.base64(F.unhex(seed))
    random = F.when(F.col("id") % 4 == 0, seed).when(F.col("id") % 4 == 1, b64).when(F.col("id") % 4 == 2, F.regexp_replace(b64, "[+/=]", "")).otherwise(F.regexp_replace(F.upper(b64), "[+/=]", ""))
    words = F.array(*[F.lit(w) for w in IDENTIFIER_WORDS])
    word = lambda k: F.element_at(words, (F.pmod(F.xxhash64("id", F.lit(k)), F.lit(len(IDENTIFIER_WORDS))) + 1).cast("int"))
    five = [word(k) for k in range(5)]
    style = F.col("id") % 6
    name = (F.when(style == 0, F.concat_ws("_", *five)).when(style == 1, F.concat(*[F.initcap(w) for w in five])).when(style == 2, F.concat_ws("-", *five))
            .when(style == 3, F.upper(F.concat_ws("_", *five))).when(style == 4, F.concat_ws("", *five)).otherwise(F.concat(F.concat_ws("/", *five), F.lit("_v"), (F.col("id") % 100).cast("string"))))
    return ids.select(F.lit(1).alias("label"), random.alias("s")).unionByName(ids.select(F.lit(0).alias("label"), name.alias("s")))


def train(labelled: DataFrame) -> list[float]:
    """The log-likelihood ratio of each bigram, row by row of the alphabet, with add-one smoothing. At most
    2 x 67 x 67 counts reach the driver."""
    n = len(ALPHABET)
    at = F.sequence(F.lit(1), F.char_length("s") - 1)
    pairs = (labelled.filter(F.char_length("s") > 1).select("label", F.explode(F.transform(at, lambda i: F.substring(F.col("s"), i, F.lit(2)))).alias("p"))
             .groupBy("label", "p").agg(F.count("*").alias("n")).collect())
    counts = [[[1.0] * n for _ in range(n)] for _ in range(2)]
    for r in pairs:
        a, b = ALPHABET.find(r.p[0]), ALPHABET.find(r.p[1])
        if a >= 0 and b >= 0:
            counts[r.label][a][b] += r.n
    prob = [[[x / sum(row) for x in row] for row in c] for c in counts]
    return [math.log(prob[1][a][b] / prob[0][a][b]) for a in range(n) for b in range(n)]


def ratio(token: Column, table: list[float]) -> Column:
    """The token's log-likelihood ratio, random over ordinary."""
    values = F.split(F.lit(",".join(f"{x:.5f}" for x in table)), ",").cast("array<double>")
    place = lambda i: F.position(F.substring(token, i, F.lit(1)), F.lit(ALPHABET)) - 1
    steps = F.sequence(F.lit(1), F.char_length(token) - 1)
    return F.aggregate(steps, F.lit(0.0), lambda sum_, i: sum_ + F.element_at(values, place(i) * len(ALPHABET) + place(i + 1) + 1))


def scan(docs: DataFrame, table: list[float] | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, base, added): arrays of (start, kind, end), kind an index into KINDS.

    Cheap guards keep the patterns off texts that cannot match; they never change a result."""
    table = train(samples(docs.sparkSession)) if table is None else table
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("t"))
    none = F.array().cast(SPANS)
    guard = lambda pattern, value: F.when(F.col("t").rlike(pattern), value).otherwise(none)
    rows = rows.select("doc_id", "t",
        guard(r"(?i:pass(?:word|wd)|secret|token|api_?key)[\"']?\x20*[:=]", _cut(F.col("t"), ASSIGN, 0, lambda v: F.char_length(v) >= ASSIGN_LEAST, 2)).alias("assign"),
        F.when(F.contains("t", F.lit("AKIA")), _cut(F.col("t"), ACCESS, 1)).otherwise(none).alias("access"),
        guard(HEX, _cut(F.col("t"), HEX, 2)).alias("hex"),
        guard(TOKEN, _cut(F.col("t"), TOKEN, 3)).alias("tokens"))
    rows = rows.select("doc_id", "t", F.array_sort(F.concat("assign", "access", "hex")).alias("base"), "tokens")
    clear = F.filter("tokens", lambda s: ~F.exists("base", lambda b: (b["start"] < s["end"]) & (s["start"] < b["end"])))
    rows = rows.select("doc_id", "t", "base", clear.alias("clear"))

    def random(s):
        token = F.substring(F.col("t"), s["start"] + 1, s["end"] - s["start"])
        return F.transform(F.array(ratio(token, table)), lambda r: (r >= LEAST_TOTAL) & (r >= LEAST_MEAN * (s["end"] - s["start"] - 1)))[0]

    return rows.select("doc_id", "base", F.filter("clear", random).alias("added"))


def spelled(spans: Column) -> Column:
    """kind:start:end, comma-joined."""
    kinds = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.element_at(kinds, s["kind"] + 1), s["start"].cast("string"), s["end"].cast("string"))), ",")


def count_kind(spans: Column, kind: int) -> Column:
    return F.size(F.filter(spans, lambda s: s["kind"] == kind)).cast("long")
