"""Token-ID files: flat unsigned integers plus 64-bit document offsets.

Layout of an output folder, one set per part (a range of document ids):

* ``part-00012.ids``   token ids of its documents, uint16 or uint32, little-endian
* ``part-00012.doc``   document ids, int64
* ``part-00012.off``   first token of each document *in the whole corpus*, int64,
  with one more entry for the end
* ``manifest``         Parquet, one row per part: counts and bases

Documents are range-partitioned and sorted by id, each task encodes its range and
writes its files; the token counts of the parts (one row each) give the bases by
prefix sums, and a second, tiny pass turns counts into global offsets.

A task writes under a name of its own attempt and renames at the end, so a lost
executor or a speculative copy leaves the same file; the folder must be shared
(a mounted path, ``file://`` or any URI that ``pyarrow.fs`` opens).  Local files are
memory-mapped on reading.

Defined cases: null text counts as empty (it gets only the end id); null ids sort
first and read back as null; repeated ids are kept, ordered by text; an empty
table gives an empty manifest; other columns are ignored.
"""

from __future__ import annotations

import json
import os
import re
import unicodedata
import uuid
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from reclink.llm.common import shuffle_partitions, stored

_CHUNK = 1 << 18  # characters given to the encoder at once
_CACHE = 800_000  # words remembered by a worker


@lru_cache(maxsize=1)
def _stop():
    """A point or comma after a letter and before a space, unless the letter ends in a mark when normalised (NFC, lower case)."""
    marked = "".join(c for c in map(chr, range(0x110000)) if c.isalpha() and not unicodedata.normalize("NFC", c).lower()[-1].isalpha())
    return re.compile(rf"(?<=[^\W\d_{marked}])([.,])(?=[ \n]|$)")


def filesystem(uri: str):
    """(pyarrow filesystem, path) of a path or URI."""
    from pyarrow import fs
    return fs.FileSystem.from_uri(uri if re.match(r"^\w+:", uri) else "file://" + os.path.abspath(uri))


class Encoder:
    """Whole-text encoding by the ``tokenizers`` library.

    ``words=True`` is for vocabularies whose pre-tokenizer drops white space, keeps
    a run of letters together and parts it from punctuation, so that no token spans
    two of them.  Then words are encoded once and remembered (up to a bounded
    number), which gives the same ids: a point or comma after a letter (one that
    stays a letter when normalised) and before a space is set apart; new words of letters only are encoded many in one string and
    told apart by the end-of-word mark of the vocabulary, if it has one.
    """

    def __init__(self, spec: str, words: bool, dtype: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer
        self.tok = Tokenizer.from_str(spec)
        self.words, self.dtype, self.known = words, np.dtype(dtype), {"": b""}
        self.last = None
        suffix = json.loads(spec)["model"].get("end_of_word_suffix")
        if words and suffix:
            vocab = self.tok.get_vocab(with_added_tokens=True)
            self.last = np.zeros(max(vocab.values()) + 1, bool)
            self.last[[i for t, i in vocab.items() if t.endswith(suffix)]] = True

    def _encode(self, texts: list[str]) -> list[bytes]:
        return [np.asarray(e.ids, self.dtype).tobytes()
                for e in self.tok.encode_batch_fast(texts, add_special_tokens=False)]

    def _learn(self, new: list[str]) -> None:
        plain = [w for w in new if w.isalpha()] if self.last is not None else []
        for a in range(0, len(plain), 4096):
            part = plain[a:a + 4096]
            ids = np.asarray(self.tok.encode_batch_fast([" ".join(part)], add_special_tokens=False)[0].ids, np.int64)
            ends = np.flatnonzero(self.last[ids]) + 1
            if len(ends) == len(part):  # every word is one run of letters after normalisation, too
                raw, width = ids.astype(self.dtype).tobytes(), self.dtype.itemsize
                cuts = [0, *(ends * width).tolist()]
                self.known.update(zip(part, map(raw.__getitem__, map(slice, cuts, cuts[1:]))))
        new = [w for w in new if w not in self.known]
        for a in range(0, len(new), 4096):
            self.known.update(zip(new[a:a + 4096], self._encode(new[a:a + 4096])))

    def encode(self, texts: list[str]) -> list[bytes]:
        """Ids of each text as bytes; long texts are never cut, many are taken in chunks."""
        if not self.words:
            out, group, size = [], [], 0
            for t in texts:
                group.append(t)
                size += len(t)
                if size > _CHUNK:
                    out += self._encode(group)
                    group, size = [], 0
            return out + (self._encode(group) if group else [])
        stop = _stop()
        split = [stop.sub(r" \1", t).replace("\n", " ").split(" ") for t in texts]
        if len(self.known) > _CACHE:
            self.known = {"": b""}
        self._learn(list(set().union(*split).difference(self.known)))
        return [b"".join(map(self.known.__getitem__, parts)) for parts in split]


_ENCODERS: dict = {}


def encoder(spec: str, words: bool, dtype: str) -> Encoder:
    """The encoder of this worker process, so that its tasks share the remembered words."""
    key = (hash(spec), words, dtype)
    if key not in _ENCODERS:
        _ENCODERS.clear()
        _ENCODERS[key] = Encoder(spec, words, dtype)
    return _ENCODERS[key]


def _replace(fs, tmp: str, final: str) -> None:
    try:
        fs.move(tmp, final)
    except OSError:
        if not fs.get_file_info(final).is_file:
            raise
        fs.delete_file(tmp)  # another attempt of this task has written the same bytes


def write_tokens(docs: DataFrame, out: str, tokenizer: str, end_id: int | None = 2, words: bool = False,
                 id_col: str = "doc_id", text_col: str = "text", parts: int | None = None) -> DataFrame:
    """Encode all documents into ``out``; returns the manifest
    (part, docs, null_docs, tokens, base_docs, base_tokens, dtype).

    ``tokenizer`` is the file of a ``tokenizers`` vocabulary; it is read on the
    driver and sent to the tasks (a few MB).
    """
    from tokenizers import Tokenizer
    spark = docs.sparkSession
    with open(tokenizer, encoding="utf-8") as f:
        spec = f.read()
    most = max(Tokenizer.from_str(spec).get_vocab_size(with_added_tokens=True) - 1, end_id or 0)
    dtype = "<u2" if most < 1 << 16 else "<u4"
    sent = spark.sparkContext.broadcast(spec)
    filesystem(out)[0].create_dir(filesystem(out)[1], recursive=True)
    end = b"" if end_id is None else np.asarray([end_id], dtype).tobytes()
    width = np.dtype(dtype).itemsize

    def encode(batches):
        fs, top = filesystem(out)
        part, attempt, enc, files = TaskContext.get().partitionId(), uuid.uuid4().hex, None, None
        n = nulls = tokens = 0
        for batch in batches:
            if not batch.num_rows:
                continue
            if files is None:
                enc = encoder(sent.value, words, dtype)
                names = {k: f"{top}/part-{part:05d}.{k}" for k in ("ids", "doc", "len")}
                files = {k: fs.open_output_stream(f"{v}.{attempt}") for k, v in names.items()}
            ids, texts = batch.column(0), batch.column(1).to_pylist()
            nulls += ids.null_count
            n += len(texts)
            files["doc"].write(ids.fill_null(0).to_numpy(zero_copy_only=False).astype("<i8").tobytes())
            for a in range(0, len(texts), 256):
                coded = [x + end for x in enc.encode([t or "" for t in texts[a:a + 256]])]
                files["ids"].write(b"".join(coded))
                lens = np.asarray([len(x) // width for x in coded], "<i8")
                tokens += int(lens.sum())
                files["len"].write(lens.tobytes())
        if files is not None:
            for k, f in files.items():
                f.close()
                _replace(fs, f"{names[k]}.{attempt}", names[k])
            yield pa.RecordBatch.from_pydict({"part": [part], "docs": [n], "null_docs": [nulls], "tokens": [tokens]},
                                             schema=pa.schema([("part", pa.int32())] + [(k, pa.int64()) for k in ("docs", "null_docs", "tokens")]))

    def offsets(batches):
        fs, top = filesystem(out)
        for batch in batches:
            for row in batch.to_pylist():
                name = f"{top}/part-{row['part']:05d}"
                with fs.open_input_file(f"{name}.len") as f:
                    lens = np.frombuffer(f.read(), "<i8")
                tmp = f"{name}.off.{uuid.uuid4().hex}"
                with fs.open_output_stream(tmp) as f:
                    f.write((row["base_tokens"] + np.concatenate([[0], np.cumsum(lens)])).astype("<i8").tobytes())
                _replace(fs, tmp, f"{name}.off")
            yield batch

    n = parts or shuffle_partitions(spark)
    ordered = (docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
               .withColumn("h", F.xxhash64("text")).repartitionByRange(n, "id", "h")
               .sortWithinPartitions("id", "h").select("id", "text"))
    counts = stored(ordered.mapInArrow(encode, "part int, docs long, null_docs long, tokens long"), "token-parts")
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # one row per part
    based = counts.select("*", F.coalesce(F.sum("docs").over(before), F.lit(0)).alias("base_docs"),
                          F.coalesce(F.sum("tokens").over(before), F.lit(0)).alias("base_tokens"),
                          F.lit(dtype).alias("dtype"))
    done = based.repartition(n, "part")
    done.mapInArrow(offsets, done.schema).write.mode("overwrite").parquet(f"{out}/manifest")
    return spark.read.schema(done.schema).parquet(f"{out}/manifest")


def read_tokens(spark: SparkSession, out: str, batch_tokens: int = 1 << 20) -> DataFrame:
    """(doc_id, start, n_tokens, ids): ids as little-endian uint32 bytes, read from the files."""
    manifest = spark.read.parquet(f"{out}/manifest")

    def read(batches):
        fs, top = filesystem(out)
        local = fs.type_name == "local"
        opened = pa.memory_map if local else fs.open_input_file
        for row in (r for b in batches for r in b.to_pylist()):
            name, width = f"{top}/part-{row['part']:05d}", np.dtype(row["dtype"]).itemsize
            with opened(f"{name}.off") as f:
                off = np.frombuffer(f.read_buffer(f.size()), "<i8")
            with opened(f"{name}.doc") as f:
                doc = np.frombuffer(f.read_buffer(f.size()), "<i8")
            with opened(f"{name}.ids") as f:
                a = 0
                while a < len(doc):
                    b = max(a + 1, int(np.searchsorted(off, off[a] + batch_tokens, "right")) - 1)
                    b = min(b, len(doc), a + 4096)
                    f.seek(int(off[a] - off[0]) * width)
                    flat = np.frombuffer(f.read((int(off[b] - off[a])) * width), row["dtype"]).astype("<u4")
                    cut = off[a:b + 1] - off[a]
                    yield pa.RecordBatch.from_arrays([
                        pa.array(doc[a:b], mask=np.arange(a, b) < row["null_docs"]),
                        pa.array(off[a:b]), pa.array(np.diff(off[a:b + 1])),
                        pa.LargeBinaryArray.from_buffers(pa.large_binary(), b - a, [None, pa.py_buffer((cut * 4).astype("<i8").tobytes()), pa.py_buffer(flat.tobytes())]).cast(pa.binary()),
                    ], names=["doc_id", "start", "n_tokens", "ids"])
                    a = b

    return manifest.repartition(max(1, shuffle_partitions(spark)), "part").mapInArrow(
        read, "doc_id long, start long, n_tokens long, ids binary")
