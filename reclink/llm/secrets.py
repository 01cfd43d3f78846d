r"""Secret scans: fixed patterns plus character Markov models of random strings.

Three base detectors (assignments, access keys, long hex runs) give spans by
regular expressions.  A fourth scores every other long token
``[A-Za-z0-9+/_=-]{min_len,}``: the first-order character Markov models of random
strings and of ordinary identifiers are compared by the log-likelihood ratio of
the token, and it is a span if the ratio exceeds ``threshold`` (prior odds).

``train`` fits both models from labelled samples: strings labelled 1 (random) or
0 (ordinary).  ``labelled_samples`` takes them from a corpus: what the base
detectors caught is random; words, identifiers (also with up to four digits in a row),
paths and drawn lines outside of that are ordinary, in all documents.  The counts are one aggregation over (label, class, class) rows; the model is at most
68 x 68 numbers, so it is collected and goes into the plan as a constant.

Only DataFrame functions are used; every text is read whole.  Offsets are code
points, end exclusive; they come from the lengths of the matches and of the
pieces between them, by blocked prefix sums, so that a text with very many
matches does not cost the square of their number.

Defined cases: null text counts as empty (no spans); repeated rows are scanned
each; an empty training table gives a model that adds nothing; extra columns of
the input are ignored.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from reclink.llm.common import let, running_sums

KINDS = ("assign", "access", "hex", "markov")  # the order of equal starts
ASSIGN = r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]+"
HEX = r"[0-9a-f]{24,}"  # the maximal runs of at least 24
# Whole runs of these characters; ``ordinary`` judges them by patterns that repeat single classes only,
# which a regular expression follows without a stack, however long a run is.
RUN = r"[A-Za-z0-9+/_=-]{6,}"
SPAN = "struct<start:bigint,kind:int,end:bigint,value:string>"

_ALPHABET = "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789+/_=-"
_N = len(_ALPHABET) + 1  # 0: the start of a token


def _token(min_len: int) -> str:
    return r"[A-Za-z0-9+/_=-]{%d,}" % min_len


def _spans(text: Column, pattern: str, kind: str, group: int = 0, least: int = 0) -> Column:
    """All matches of ``pattern`` whose ``group`` has at least ``least`` characters."""
    def build(m):
        matches, pieces, values = m["m"], m["p"], m["v"]
        lens = F.zip_with(F.slice(pieces, F.lit(1), F.size(matches)), matches, lambda p, x: F.length(p) + F.length(x))
        return let(running_sums(lens), lambda at: F.transform(
            matches, lambda x, i: F.struct(
                (F.get(at, i) + F.length(F.get(pieces, i))).alias("start"),
                F.lit(KINDS.index(kind)).alias("kind"),
                (F.get(at, i) + F.length(F.get(pieces, i)) + F.length(x)).alias("end"),
                F.get(values, i).alias("value"))))
    matches = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    values = F.regexp_extract_all(text, F.lit(pattern), F.lit(group)) if group else matches
    found = let(F.struct(matches.alias("m"), F.split(text, pattern, -1).alias("p"), values.alias("v")), build)
    if least:
        found = F.filter(found, lambda s: F.length(s["value"]) >= least)
    return F.when(F.regexp_like(text, F.lit(pattern)), found).otherwise(F.array().cast(f"array<{SPAN}>"))


def base_spans(text: Column) -> Column:
    """array<struct<start, kind, end, value>> sorted by start, then kind as listed."""
    return F.array_sort(F.concat(_spans(text, ASSIGN, "assign", 2, 6), _spans(text, ACCESS, "access", 0, 20),
                                 _spans(text, HEX, "hex")))


def ordinary(run: Column) -> Column:
    """Runs of at least two letters (or ``_/-``) with up to four digits between or after them, and lines drawn with symbols."""
    likes = lambda p: F.regexp_like(run, F.lit(p))
    return likes("^[+/_=-]+$") | ~(likes("[+=]") | likes("^[0-9]") | likes("[0-9]{5}") | likes("(?:^|[0-9])[A-Za-z_/-](?:[0-9]|$)"))


def _outside(spans: Column, base: Column) -> Column:
    return F.filter(spans, lambda s: ~F.exists(base, lambda b: (b["start"] < s["end"]) & (s["start"] < b["end"])))


def labelled_samples(docs: DataFrame, text_col: str = "text", min_len: int = 20) -> DataFrame:
    """(value, label) rows of all documents: base values of at least ``min_len`` characters are 1;
    ordinary words, identifiers, paths and rules of at least 6 characters outside them are 0."""
    text = docs.select(F.coalesce(F.col(text_col), F.lit("")).alias("t"))
    base = f"{ASSIGN}|{ACCESS}|{HEX}"
    pos = (text.where(F.regexp_like("t", F.lit(base))).select(F.explode(F.transform(base_spans(F.col("t")), lambda s: s["value"])).alias("value"), F.lit(1).alias("label"))
           .where(F.length("value") >= min_len))
    neg = text.select(F.explode(F.filter(F.regexp_extract_all(F.regexp_replace("t", base, " "), F.lit(RUN), F.lit(0)), ordinary)).alias("value"), F.lit(0).alias("label"))
    return pos.unionByName(neg)


def _codes(value: Column) -> Column:
    """Alphabet position (1..) of each character; 0 stands before the first."""
    return F.concat(F.array(F.lit(0)), F.transform(
        F.split(value, ""), lambda c: F.instr(F.lit(_ALPHABET), c)))


def train(samples: DataFrame, alpha: float = 0.5) -> list[float]:
    """Log-likelihood ratios log P(b|a, random) - log P(b|a, ordinary), row-major by (a, b).

    ``samples``: (value, label).  Laplace smoothing by ``alpha``; both labels must
    occur, else the ratios are all 0.
    """
    # equal values are counted first, so that each is taken apart once
    codes = (samples.where("value IS NOT NULL AND value <> '' AND label IS NOT NULL").groupBy("label", "value").agg(F.count(F.lit(1)).alias("times"))
             .select("label", "times", _codes(F.col("value")).alias("c")))
    steps = F.transform(F.sequence(F.lit(0), F.size("c") - 2), lambda i: F.get(F.col("c"), i) * _N + F.get(F.col("c"), i + 1))
    counts = (codes.where(F.size("c") > 1).select("label", "times", F.explode(steps).alias("step"))
              .groupBy("label", "step").agg(F.sum("times").alias("count")).collect())
    table = {0: [0.0] * (_N * _N), 1: [0.0] * (_N * _N)}
    for r in counts:  # at most 2 x 68 x 68 rows
        table[1 if r["label"] else 0][r["step"]] += r["count"]
    if not any(table[0]) or not any(table[1]):
        return [0.0] * (_N * _N)

    sums = {k: [sum(t[a * _N:(a + 1) * _N]) for a in range(_N)] for k, t in table.items()}
    ratio = lambda k, i: math.log((table[k][i] + alpha) / (sums[k][i // _N] + alpha * _N))
    return [ratio(1, i) - ratio(0, i) for i in range(_N * _N)]


def llr(value: Column, model: list[float]) -> Column:
    """Log-likelihood ratio of a token: positive speaks for a random string."""
    table = F.lit(model)
    return let(_codes(value), lambda c: F.aggregate(
        F.sequence(F.lit(0), F.size(c) - 2), F.lit(0.0),
        lambda s, i: s + F.get(table, F.get(c, i) * _N + F.get(c, i + 1))))


def scan(docs: DataFrame, model: list[float], id_col: str = "doc_id", text_col: str = "text",
         min_len: int = 20, threshold: float = math.log(1e4)) -> DataFrame:
    """(id_col, base, markov): span arrays of every whole text.

    ``markov`` spans are tokens outside every base span whose log-likelihood ratio
    exceeds ``threshold``.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(F.col(id_col).alias("id"), text.alias("t"))
    token = _token(min_len)
    looks = lambda s: llr(s["value"], model) > threshold
    found = rows.select("id", let(base_spans(F.col("t")), lambda b: F.struct(
        b.alias("base"), F.filter(_outside(_spans(F.col("t"), token, "markov"), b), looks).alias("markov"))).alias("s"))
    return found.select(F.col("id").alias(id_col), "s.base", "s.markov")


def mask(text: Column, spans: Column, by: str = "█") -> Column:
    """The text with each span's characters replaced, for a cleaned copy of the corpus."""
    return F.aggregate(spans, text, lambda t, s: F.overlay(
        t, F.repeat(F.lit(by), (s["end"] - s["start"]).cast("int")), (s["start"] + 1).cast("int"), (s["end"] - s["start"]).cast("int")))


def digest_text(spans: Column) -> Column:
    """kind:start:end, comma-joined."""
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(
        ":", F.get(names, s["kind"]), s["start"].cast("string"), s["end"].cast("string"))), ",")
