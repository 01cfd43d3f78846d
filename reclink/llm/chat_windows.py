r"""Chat formatting: token-budgeted, turn-aligned windows with a loss mask.

A turn becomes ``<turn ROLE>\nTEXT\n</turn>\n``.  Inside a text every ``<turn`` or
``</turn`` gets a backslash in front, and the backslashes already there are
doubled, so texts can hold the template's own marks and are read back exactly
(``escape``/``unescape``); roles escape ``\``, ``>`` and line ends.

Prefix sums of turn tokens per conversation say where each turn lies.  They are
taken in two levels (inside range partitions, then over partition totals), so one
conversation may hold any share of all rows.  Every ``segment_tokens`` of prefix a
new segment begins; windows are packed inside a segment, which bounds the rows a
task holds.  A window holds the conversation's system turn (if its first turn is
one), as many of the last turns before it as fit ``history_tokens``, and the
longest run of new turns that keeps it within ``budget``.  Only assistant texts of
*new* turns are in the loss mask, so each is trained on once; repeated ones are
masked.  A single turn over the budget gets a window of its own, whole.  A system turn
of more than ``system_share`` of the budget stands once, whole, with the first new turns
if they fit, and is not repeated: later windows would hold little else.

Defined cases: null role and text count as empty; null turns sort first, equal
turns by role and text; repeated rows are turns each; null conversation ids form
one conversation; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import re

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from reclink.llm.common import grouped, shuffle_partitions, stored
from reclink.llm.token_files import encoder

_MARK = re.compile(r"(\\*)(</?turn)")
_TURN = re.compile(r"<turn ((?:[^>\\\n]|\\.)*)>\n(.*?)\n</turn>\n", re.S)


def escape(text: str) -> str:
    return _MARK.sub(lambda m: m[1] * 2 + "\\" + m[2], text)


def unescape(text: str) -> str:
    return _MARK.sub(lambda m: "\\" * (len(m[1]) // 2) + m[2], text)


def _role(role: str) -> str:
    return role.replace("\\", "\\\\").replace(">", "\\>").replace("\n", "\\n")


def _unrole(role: str) -> str:
    return re.sub(r"\\(.)", lambda m: "\n" if m[1] == "n" else m[1], role)


def piece(role: str, text: str) -> str:
    return f"<turn {_role(role)}>\n{escape(text)}\n</turn>\n"


def turns_of(formatted: str) -> list[tuple[str, str]]:
    """(role, text) of each turn of a formatted string, unescaped."""
    return [(_unrole(m[1]), unescape(m[2])) for m in _TURN.finditer(formatted)]


WINDOW = ("conv_id long, segment long, window int, text string, n_tokens long, new_at int, n_new int, "
          "over_budget boolean, loss array<struct<start:int,end:int>>")


def _pack(rows: list[dict], budget: int, history: int, system_share: float = 0.5) -> list[dict]:
    """Windows of one segment; rows (system copy, history, new turns) are in order."""
    system = next((r for r in rows if (r["kind"] == "system" or r["rank"] == 0 and r["role"] == "system") and r["tokens"] <= system_share * budget), None)
    turns = [r for r in rows if r["kind"] != "system"]
    first = next((i for i, r in enumerate(turns) if r["kind"] == "new"), len(turns))
    sums = [0]
    for r in turns:
        sums.append(sums[-1] + r["tokens"])
    out, i = [], first
    while i < len(turns):
        lead = [] if system is None or turns[i] is system else [system]
        room = budget - sum(r["tokens"] for r in lead)
        back = i
        while back > 0 and turns[back - 1] is not system and sums[i] - sums[back - 1] <= history:
            back -= 1
        while back < i and sums[i + 1] - sums[back] > room:
            back += 1  # less history rather than no new turn
        end = i + 1
        while end < len(turns) and sums[end + 1] - sums[back] <= room:
            end += 1
        lead = lead + turns[back:i]
        text = "".join(piece(r["role"], r["text"]) for r in lead)
        new_at, loss = len(text), []
        parts = [text]
        at = new_at
        for r in turns[i:end]:
            p = piece(r["role"], r["text"])
            if r["role"] == "assistant":
                start = at + len(f"<turn {_role(r['role'])}>\n")
                loss.append({"start": start, "end": at + len(p) - len("\n</turn>\n")})
            parts.append(p)
            at += len(p)
        tokens = sum(r["tokens"] for r in lead) + sums[end] - sums[i]
        out.append({"window": len(out), "text": "".join(parts), "n_tokens": tokens, "new_at": new_at,
                    "n_new": end - i, "over_budget": tokens > budget, "loss": loss})
        i = end
    return out


def format_windows(turns: DataFrame, tokenizer: str, budget: int = 1024, history_tokens: int = 256,
                   segment_tokens: int | None = None, words: bool = False, system_share: float = 0.5) -> DataFrame:
    """conversations (conv_id, turn, role, text) -> one row per window (see WINDOW).

    ``new_at`` is the code point where new turns begin, ``loss`` the code point
    spans of the (escaped) texts to train on.
    """
    spark = turns.sparkSession
    segment = segment_tokens or 64 * budget
    with open(tokenizer, encoding="utf-8") as f:
        sent = spark.sparkContext.broadcast(f.read())

    def count(batches):
        enc = encoder(sent.value, words, "<u4")
        for b in batches:
            pieces = [piece(r, t) for r, t in zip(b.column("role").to_pylist(), b.column("text").to_pylist())]
            yield b.append_column("tokens", pa.array([len(x) // 4 for x in enc.encode(pieces)], pa.int64()))

    base = turns.select(F.col("conv_id").cast("long").alias("conv"), F.col("turn").cast("long").alias("turn"),
                        F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    key = ["conv", "turn", "role", "th", "nth"]
    counted = (base.mapInArrow(count, "conv long, turn long, role string, text string, tokens long")
               .withColumn("th", F.xxhash64("text")).withColumn("nth", F.monotonically_increasing_id()))
    # The range partitioning samples its input first; from a table, that costs no second pass of the tokenizer.
    placed = stored(stored(counted, "turn-tokens").repartitionByRange(shuffle_partitions(spark), *key)
                    .withColumn("part", F.spark_partition_id()), "turns")
    # Two-level prefix sums: inside (part, conversation), then over the parts of a conversation.
    inside = Window.partitionBy("part", "conv").orderBy("conv", "turn", "role", "th", "nth")
    totals = placed.groupBy("part", "conv").agg(F.sum("tokens").alias("t"), F.count("*").alias("c"))
    before = Window.partitionBy("conv").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    bases = totals.select(F.col("part").alias("bpart"), F.col("conv").alias("bconv"),
                          F.coalesce(F.sum("t").over(before), F.lit(0)).alias("base"),
                          F.coalesce(F.sum("c").over(before), F.lit(0)).alias("base_rows"),
                          F.sum("t").over(Window.partitionBy("conv")).alias("total"))
    run = inside.rowsBetween(Window.unboundedPreceding, 0)
    rows = (placed.withColumn("run", F.sum("tokens").over(run)).withColumn("nr", F.row_number().over(inside))
            .join(bases, (F.col("part") == F.col("bpart")) & F.col("conv").eqNullSafe(F.col("bconv")))
            .withColumn("prefix", F.col("base") + F.col("run") - F.col("tokens"))
            .withColumn("rank", F.col("base_rows") + F.col("nr") - 1)
            .withColumn("segment", F.expr(f"prefix div {segment}")))
    # A row also goes to the next segment as history, a system turn to all later ones.
    copy = lambda kind, seg: F.struct(F.lit(kind).alias("kind"), seg.alias("segment"))
    last = F.expr(f"total div {segment}")
    is_system = (F.col("rank") == 0) & (F.col("role") == "system") & (F.col("tokens") <= system_share * budget)
    none = F.array().cast("array<struct<kind:string,segment:bigint>>")
    copies = F.concat(
        F.array(copy("new", F.col("segment"))),
        F.when(~is_system & (F.col("prefix") >= (F.col("segment") + 1) * segment - history_tokens) & (F.col("segment") < last),
               F.array(copy("history", F.col("segment") + 1))).otherwise(none),
        F.when(is_system & (F.col("segment") < last), F.transform(
            F.sequence(F.col("segment") + 1, F.greatest(last, F.col("segment") + 1)), lambda s: copy("system", s))).otherwise(none))
    sent_out = (rows.select("conv", "role", "text", "tokens", "rank", F.explode(copies).alias("c"))
                .select("conv", F.col("c.segment").alias("segment"), "rank", F.col("c.kind").alias("kind"), "role", "text", "tokens")
                .repartition(shuffle_partitions(spark), "conv", "segment").sortWithinPartitions("conv", "segment", "rank"))

    def pack(batches):
        schema = pa.schema([("conv_id", pa.int64()), ("segment", pa.int64()), ("window", pa.int32()), ("text", pa.string()),
                            ("n_tokens", pa.int64()), ("new_at", pa.int32()), ("n_new", pa.int32()), ("over_budget", pa.bool_()),
                            ("loss", pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())])))])
        held, size = [], 0
        for (conv, seg), group in grouped(batches, ["conv", "segment"]):
            for w in _pack(group, budget, history_tokens, system_share):
                held.append({"conv_id": conv, "segment": seg} | w)
                size += len(w["text"])
            if size > 1 << 22:
                yield pa.RecordBatch.from_pylist(held, schema=schema)
                held, size = [], 0
        if held:
            yield pa.RecordBatch.from_pylist(held, schema=schema)

    return sent_out.mapInArrow(pack, WINDOW)


def digests(windows: DataFrame) -> DataFrame:
    """Read the windows back: per conversation, counts and digests of its turns and loss texts.

    A digest runs over a whole conversation in order, so its windows pass one task;
    they are streamed, not gathered.
    """
    def read(batches):
        schema = pa.schema([("conv_id", pa.int64()), ("n_turns", pa.int64()), ("turns_sha256", pa.string()),
                            ("loss_chars", pa.int64()), ("loss_sha256", pa.string()), ("formatted_chars", pa.int64()),
                            ("n_windows", pa.int64())])
        state, now = None, object()

        def done(s):
            return pa.RecordBatch.from_pylist([{"conv_id": now, "n_turns": s[0], "turns_sha256": s[1].hexdigest(), "loss_chars": s[2],
                                                "loss_sha256": s[3].hexdigest(), "formatted_chars": s[4], "n_windows": s[5]}], schema=schema)
        for b in batches:
            out = []
            for conv, text, new_at, loss in zip(*(b.column(c).to_pylist() for c in ("conv_id", "text", "new_at", "loss"))):
                if state is None or conv != now:
                    if state is not None:
                        out.append(done(state))
                    now, state = conv, [0, hashlib.sha256(), 0, hashlib.sha256(), 0, 0]
                for role, said in turns_of(text[new_at:]):
                    state[0] += 1
                    state[1].update(f"{role}\n{said}\n".encode("utf-8", "surrogatepass"))
                for span in loss:
                    plain = unescape(text[span["start"]:span["end"]])
                    state[2] += len(plain)
                    state[3].update(plain.encode("utf-8", "surrogatepass"))
                state[4] += len(text)
                state[5] += 1
            if out:
                yield pa.Table.from_batches(out).combine_chunks().to_batches()[0]
        if state is not None:
            yield done(state)

    return (windows.select("conv_id", "segment", "window", "text", "new_at", "loss")
            .repartition(shuffle_partitions(windows.sparkSession), "conv_id")
            .sortWithinPartitions("conv_id", "segment", "window")
            .mapInArrow(read, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, "
                              "loss_sha256 string, formatted_chars long, n_windows long"))
