r"""Benchmark decontamination by template canonicalisation.

Texts become templates: every number is ``#``, every name (a capitalised word, wherever
it stands) ``@``, every unit after a number ``&``; other words are lower-cased and
punctuation, quotes and white space go.  Windows of ``window`` template tokens of all
documents are hash-joined with those of the benchmark items, and so are windows of the
plain lower-cased tokens, so that a verbatim copy in other case depends on no slot.  Items under three windows are cut into
windows of half the length, so that one changed word leaves matches on both sides.

Matches of one (document, item) are kept by diagonal (document place minus item
place); diagonals at most ``gap`` apart are one place of the document, and each item
window counts on its strongest one.  A place is a leak if its matched windows hold as
many tokens of the item as ``coverage`` of its windows of full length span, or if
``verbatim`` tokens in a row are copied, whatever their share.  Unless it is copied
verbatim, the values in the slots of the matched windows are compared: each value of
the item must stand for one value in the document (3 -> 7 everywhere, Ann -> Bob
everywhere), on the merged diagonals or on one that suffices alone.  So a question
with other numbers and names is caught, and a chance match of templates is not.

Items shorter than a window are matched whole: by their template if at least two of
their tokens are words, else by their values; an item of one token only matches
a document that is this token.

The document side is one pass: template tokens are hashed to 64 bits, windows are
folded by doubling (array operations, no Python), and the windows meet the
benchmark's in a broadcast join if those are at most ``broadcast_windows``
(counted first), else in a shuffle join.  The texts are read again only for
matches of items with slots.

Defined cases: null or empty texts and items match nothing; repeated documents are each reported, under
their id; null ids are reported as null; an empty benchmark gives no rows; other
columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from reclink.llm.common import let

UNITS = ("km|kg|cm|mm|m|g|mg|l|ml|lb|lbs|oz|ft|in|mi|mph|kmh|hours?|minutes?|seconds?|days?|weeks?|months?|years?|"
         "miles?|meters?|metres?|liters?|litres?|grams?|pounds?|dollars?|euros?|cents?|percent|degrees?")
# Points and commas that part no digits go first, so that numbers and separators are runs of one
# class of characters: a regular expression follows those without a stack, however long they are.
_LOOSE_MARK = r"(?<!\p{N})[.,]|[.,](?!\p{N})"
_NUMBER = r"\p{N}[\p{N}.,]*"
_NAME = r"(?<![\p{L}\p{N}&])(\p{Lu}\p{Ll}\p{L}*)"  # not words in capitals only
_SEPARATORS = r"[^\p{L}\p{N}#@&.,]+"


def marked(text: Column) -> Column:
    """The lower-cased text with ``#``, ``@`` and ``&`` in front of numbers, names and units."""
    c = F.translate(F.coalesce(text, F.lit("")), "#@&\u00ad\u200b\ufeff", "   ")  # the marks, and letters that show nothing
    c = F.regexp_replace(c, _LOOSE_MARK, " ")
    c = F.regexp_replace(c, f"({_NUMBER})", " #$1 ")
    c = F.regexp_replace(c, rf"(?i)(#[\p{{N}}.,]*\p{{N}})[\s\p{{Z}}]+({UNITS})(?![\p{{L}}\p{{N}}])", "$1 &$2")
    c = F.regexp_replace(c, _NAME, "@$1")
    return F.lower(c)


def _tokens(c: Column) -> Column:
    return F.filter(F.split(c, _SEPARATORS, -1), lambda t: t != "")


def slots_and_words(text: Column) -> Column:
    """Tokens with their values: ``#12.5``, ``@ann``, ``&km``, ``word``."""
    return _tokens(marked(text))


def is_slot(token: Column) -> Column:
    return F.substring(token, 1, 1).isin("#", "@", "&")


def slot_or_word(token: Column) -> Column:
    """A token of the template: the value is left out."""
    return F.when(is_slot(token), F.substring(token, 1, 1)).otherwise(token)


def plain(token: Column) -> Column:
    """A token of the plain text: the mark is left out."""
    return F.when(is_slot(token), F.substr(token, F.lit(2))).otherwise(token)


def run_hashes(tokens: Column, lengths: list[int]) -> Column:
    """array<array<long>>: 64-bit hashes of all runs of each of the ascending ``lengths``, by folding runs of doubled length."""
    def pairs(runs: Column, shift: int, *tag) -> Column:
        rest = F.greatest(F.size(runs) - shift, F.lit(0))
        return F.zip_with(F.slice(runs, F.lit(1), rest), F.slice(runs, F.lit(shift + 1), rest), lambda x, y: F.xxhash64(x, y, *tag))

    def fold(runs: Column, length: int, todo: list[int]) -> Column:
        # two overlapping runs of a power of two make one of a length up to its double
        here = [runs if n == length else pairs(runs, n - length, F.lit(n)) for n in todo if n < 2 * length]
        more = [n for n in todo if n >= 2 * length]
        out = F.array(*here) if here else None
        if more:
            longer = let(pairs(runs, length), lambda r: fold(r, 2 * length, more))
            out = longer if out is None else F.concat(out, longer)
        return out
    return let(F.transform(tokens, lambda t: F.xxhash64(t)), lambda runs: fold(runs, 1, lengths))


def window_hashes(tokens: Column, window: int) -> Column:
    """64-bit hashes of all runs of ``window`` tokens."""
    return run_hashes(tokens, [window])[0]


def both_windows(tokens: Column, lengths: list[int]) -> Column:
    """array<struct<w, n, h>>: hashes of the n template runs of each length w, then of the plain ones (null where they are the same)."""
    return let(tokens, lambda v: let(run_hashes(F.transform(v, slot_or_word), lengths), lambda t: let(
        run_hashes(F.transform(v, plain), lengths), lambda p: F.array(*[F.struct(
            F.lit(w).alias("w"), F.size(t[i]).alias("n"),
            F.concat(t[i], F.zip_with(p[i], t[i], lambda x, y: F.when(x != y, x))).alias("h")) for i, w in enumerate(lengths)]))))


def covered(at: Column, w: Column) -> Column:
    """Number of tokens in the windows of ``w`` tokens that begin at the ascending places ``at``."""
    steps = F.zip_with(F.slice(at, F.lit(2), F.greatest(F.size(at) - 1, F.lit(0))), F.slice(at, F.lit(1), F.greatest(F.size(at) - 1, F.lit(0))),
                       lambda y, x: F.least(w, y - x))
    return F.when(F.size(at) == 0, 0).otherwise(F.aggregate(steps, w, lambda s, x: s + x))


def find_leaks(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text",
               item_col: str = "item_id", item_text: str = "text", window: int = 8, coverage: float = 0.5,
               broadcast_windows: int = 500_000, verbatim: int = 13, gap: int = 16) -> DataFrame:
    """(id_col, item_col, matched, windows, coverage, slots): the best match of each leaked pair.

    ``matched`` of the item's ``windows`` were found, which hold the share ``coverage``
    of its tokens; ``slots`` of them are values.  ``window`` is a power of two.
    """
    if window & (window - 1) or window < 2:
        raise ValueError("window must be a power of two")
    size, whole = F.size("v"), F.size("v") < window
    items = (benchmark.select(F.col(item_col).alias("item"), slots_and_words(F.col(item_text)).alias("v"))
             .where(size > 0).distinct()
             .withColumn("nr", F.xxhash64("item", "v"))
             .withColumn("n", size)
             .withColumn("w", F.when(whole, size).when(size < 3 * window, window // 2).otherwise(window))
             # the tokens that half of its windows span
             .withColumn("need", F.when(whole, size).otherwise(F.ceil((size - window + 1) * coverage).cast("int") + window - 1))
             # a short item of values and one word at most is only known by its values
             .withColumn("by_form", ~whole | (F.size(F.filter("v", lambda t: ~is_slot(t))) >= 2)))
    counts = {r["w"]: r["c"] for r in items.groupBy("w").agg(F.sum(F.col("n") - F.col("w") + 1).alias("c")).collect()}  # at most ``window`` rows
    lengths = sorted(counts) or [window]
    item_windows = (items.withColumnsRenamed({"n": "item_n", "w": "item_w"}).withColumn("b", both_windows(F.col("v"), lengths))
                    .select("nr", "item_n", "item_w", "need", "by_form", F.explode("b").alias("b")).where("b.w = item_w")
                    .select("nr", "item_n", "item_w", "need", "by_form", "b.n", F.col("b.h").alias("all"), F.posexplode("b.h").alias("at", "h"))
                    .where("h IS NOT NULL")
                    # verbatim: a window of the plain text, or one without a slot
                    .withColumn("verbatim", (F.col("at") >= F.col("n")) | F.get("all", F.col("at") + F.col("n")).isNull())
                    .where("verbatim OR by_form")
                    .select("nr", F.col("item_n").alias("n"), F.col("item_w").alias("w"), "need", "verbatim", F.pmod("at", "n").alias("ipos"), "h"))
    if 2 * sum(counts.values()) <= broadcast_windows:
        item_windows = F.broadcast(item_windows)

    doc_hash = F.xxhash64(F.col(text_col))  # with the id, it names a document and tells its text
    found = both_windows(slots_and_words(F.col(text_col)), lengths)
    if lengths[0] == 1:  # one token is a copy only if it is the whole document
        found = F.filter(found, lambda b: (b["w"] > 1) | (b["n"] == 1))
    doc_windows = (docs.select(F.col(id_col).alias("id"), doc_hash.alias("dh"), F.explode(found).alias("b"))
                   .select("id", "dh", F.col("b.n").alias("doc_n"), F.posexplode("b.h").alias("at", "h")).where("h IS NOT NULL")
                   .select("id", "dh", F.pmod("at", "doc_n").alias("pos"), "h"))

    pair = ["id", "dh", "nr", "n", "w", "need"]
    some = lambda c: F.sort_array(F.collect_set(c))
    diagonals = (doc_windows.join(item_windows, "h")
                 .select(*pair, (F.col("pos") - F.col("ipos")).alias("diagonal"), "ipos", "verbatim")
                 .repartition("id", "dh", "nr")
                 .groupBy(*pair, "diagonal").agg(some("ipos").alias("at"), some(F.when(F.col("verbatim"), F.col("ipos"))).alias("same")))
    # neighbouring diagonals are one place of the document: words went in or out between them
    along = Window.partitionBy("id", "dh", "nr").orderBy("diagonal")
    diagonals = (diagonals.withColumn("apart", F.coalesce(F.col("diagonal") - F.lag("diagonal").over(along) > gap, F.lit(False)).cast("int"))
                 .withColumn("place", F.sum("apart").over(along)))
    # a run: ``verbatim`` tokens, so many windows one after the other
    run = F.lit(verbatim) - F.col("w")
    diagonals = diagonals.withColumn("run", F.exists(F.transform("same", lambda x, i: F.get("same", i + run) - x), lambda d: d.eqNullSafe(run)) & (run > 0))
    alone = F.when(covered(F.col("at"), F.col("w")) >= F.col("need"), F.transform("at", lambda i: F.struct(i.alias("ipos"), F.col("diagonal").alias("diagonal"))))
    places = (diagonals.groupBy(*pair, "place").agg(F.max("run").alias("run"), F.count(F.lit(1)).alias("n_diagonals"), F.collect_list(alone).alias("alone")))
    merged = (diagonals.select(*pair, "place", "diagonal", F.size("at").alias("m"), "same", F.explode("at").alias("ipos"))
              .groupBy(*pair, "place", "ipos").agg(F.max_by("diagonal", F.struct("m", -F.col("diagonal"))).alias("diagonal"),
                                                   F.max(F.array_contains("same", F.col("ipos"))).alias("same"))
              .groupBy(*pair, "place").agg(F.sort_array(F.collect_list(F.struct("ipos", "diagonal"))).alias("all"),
                                           F.sort_array(F.collect_list(F.when(F.col("same"), F.col("ipos")))).alias("same")))
    starts = lambda c: F.transform(c, lambda x: x["ipos"])
    both = places.select(*[F.col(c).alias(f"_{c}") for c in ("id", "dh", "nr", "place")], "run", "n_diagonals", "alone")
    hits = (merged.join(both, F.col("id").eqNullSafe(F.col("_id")) & (F.col("dh") == F.col("_dh")) & (F.col("nr") == F.col("_nr")) & (F.col("place") == F.col("_place")))
            .withColumn("copied", F.col("run") | (covered(F.col("same"), F.col("w")) >= F.col("need")))
            .withColumn("tries", F.concat(
                F.when(covered(starts("all"), F.col("w")) >= F.col("need"), F.array("all")).otherwise(F.array().cast("array<array<struct<ipos:int,diagonal:int>>>")),
                F.when(F.col("n_diagonals") > 1, F.col("alone")).otherwise(F.array().cast("array<array<struct<ipos:int,diagonal:int>>>"))))
            .where(F.col("copied") | (F.size("tries") > 0))
            .select(*pair, "copied", "same", "tries"))

    item_slots = items.select("nr", "item", F.filter(
        F.transform("v", lambda t, i: F.struct(i.alias("at"), t.alias("t"))), lambda s: is_slot(s["t"])).alias("slots"))
    hits = hits.join(item_slots, "nr")
    result = lambda at, slots: F.struct(
        (covered(at, F.col("w")) / F.col("n")).alias("coverage"), F.size(at).alias("matched"), (F.col("n") - F.col("w") + 1).alias("windows"), slots.alias("slots"))
    inside = lambda s, i: (i <= s["at"]) & (s["at"] < i + F.col("w"))
    copied = hits.where("copied").select("id", "dh", "item", result(
        F.col("same"), F.size(F.filter("slots", lambda s: F.exists("same", lambda i: inside(s, i))))).alias("b"))
    texts = docs.select(F.col(id_col).alias("tid"), doc_hash.alias("tdh"), F.col(text_col).alias("t")).dropDuplicates(["tid", "tdh"])

    def values(v: Column, at: Column) -> Column:
        """Values of the item and of the document in the slots of the matched windows; what stands beyond them is the document's own."""
        return F.array_distinct(F.flatten(F.transform("slots", lambda s: F.transform(
            F.filter(at, lambda x: inside(s, x["ipos"])),
            lambda x: F.struct(plain(s["t"]).alias("a"), plain(F.get(v, s["at"] + x["diagonal"])).alias("b"), s["at"].alias("at"))))))

    def kept(v: Column) -> Column:
        """The best match in which each value of the item stands for one value."""
        return F.array_max(F.filter(F.transform("tries", lambda at: let(values(v, at), lambda p: F.when(
            F.size(F.array_distinct(F.transform(p, lambda x: F.struct(x["a"], x["b"])))) == F.size(F.array_distinct(F.transform(p, lambda x: x["a"]))),
            result(F.transform(at, lambda x: x["ipos"]), F.size(F.array_distinct(F.transform(p, lambda x: x["at"]))))))), lambda b: b.isNotNull()))
    compared = (hits.where(~F.col("copied"))
                .join(texts, F.col("id").eqNullSafe(F.col("tid")) & (F.col("dh") == F.col("tdh")))
                .select("id", "dh", "item", let(slots_and_words(F.col("t")), kept).alias("b")).where("b IS NOT NULL"))
    best = copied.unionByName(compared).groupBy("id", "item").agg(F.max("b").alias("b"))
    return best.select(F.col("id").alias(id_col), F.col("item").alias(item_col), "b.matched", "b.windows", "b.coverage", "b.slots")


def without_leaks(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", **options) -> DataFrame:
    """The documents with no leaked item (all of a leaked id go; documents without an id stay)."""
    leaked = find_leaks(docs, benchmark, id_col=id_col, **options).select(F.col(id_col).alias("_leaked")).distinct()
    return docs.join(leaked, docs[id_col] == F.col("_leaked"), "left_anti")
