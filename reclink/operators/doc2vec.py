"""Training of ``topics.fit_doc2vec`` (T5): skip-gram with negative samples over blocks of documents.

Documents are packed into blocks of about ``_BLOCK`` tokens, one row each: the block's distinct terms with
their counts, and the tokens as places in them.  The counts of all blocks give the vocabulary; a pass joins
each block with the vectors of its terms, trains in numpy and averages a term's vectors over the blocks
that hold it, as Word2Vec does over its partitions.  Blocks follow the tokens, never the cluster.

A step takes ``_STEP`` consecutive tokens as centres.  Neighbours stand in a band beside them, so products,
slopes and sums of all pairs are matrix products of tiles: rows are fetched once a token, not once a pair.
All pairs up to ``window`` known tokens apart count, within a document (a text beyond two blocks is cut).
Negative samples come from the block's terms, in proportion to count^0.75, shared by a step's pairs.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.errors import IllegalArgumentException
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from reclink.operators import lda, wordvec
from reclink.session import materialize

_BLOCK = 1 << 21  # tokens of a block
_STEP, _TILE, _SHARED = 512, 16, 64  # centres of a step and of a tile, and the negative samples a step shares


def pack(batches):
    """Batches of token lists -> one row a block: (block, terms, n, codes, ends); null lists and tokens are left out."""
    first, made, tokens, ends, total = TaskContext.get().partitionId() << 32, 0, [], [], 0

    def cut(size):
        nonlocal made, tokens, ends, total
        whole, stops = pa.concat_arrays(tokens), np.concatenate(ends)
        encoded = whole.slice(0, size).dictionary_encode()
        codes, inside = encoded.indices.to_numpy(), stops[stops < size]
        row = [pa.array([first + made], pa.int64()), pa.array([encoded.dictionary], pa.list_(pa.string())),
               pa.array([np.bincount(codes, minlength=len(encoded.dictionary))], pa.list_(pa.int64())),
               pa.array([codes.astype(np.int32).tobytes()], pa.binary()), pa.array([np.append(inside, size).astype(np.int64).tobytes()], pa.binary())]
        made, tokens, ends, total = made + 1, [whole.slice(size)], [stops[stops > size] - size], total - size
        return pa.RecordBatch.from_arrays(row, names=["block", "terms", "n", "codes", "ends"])

    for b in batches:
        lists = b.column(0)
        words = lists.flatten()
        sizes = lists.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
        if words.null_count:
            known = words.is_valid().to_numpy(zero_copy_only=False)
            sizes = np.bincount(np.repeat(np.arange(len(sizes)), sizes), known, len(sizes)).astype(np.int64)
            words = words.drop_null()
        tokens.append(words)
        ends.append(total + np.cumsum(sizes))
        total += len(words)
        while total >= _BLOCK:
            stops = np.concatenate(ends)
            yield cut(min(int(stops[np.searchsorted(stops, _BLOCK)]), 2 * _BLOCK))
    if total:
        yield cut(total)


def _add(table: np.ndarray, ids: np.ndarray, change: np.ndarray, weight: np.ndarray, rate: float) -> None:
    """Adds the sums of changes by row; a row's changes count over the root of their weight."""
    by = np.argsort(ids, kind="stable")
    rows = ids[by]
    starts = np.flatnonzero(np.diff(rows, prepend=-1))
    total = np.add.reduceat(change.take(by, 0), starts)
    total *= rate * wordvec._damp(np.add.reduceat(weight[by], starts))[:, None]
    table[rows[starts]] += total


def _tiles(m: np.ndarray, n: int, width: int) -> np.ndarray:
    """``n`` overlapping runs of ``width`` rows, one beginning every ``_TILE`` rows."""
    return np.lib.stride_tricks.as_strided(m, (n, width, *m.shape[1:]), (_TILE * m.strides[0], *m.strides))


def train(word: np.ndarray, context: np.ndarray, ids: np.ndarray, doc: np.ndarray, noise_w: np.ndarray, rng, rates: tuple,
          window: int, negatives: int) -> None:
    """Steps over all pairs of the rows ``ids``, in place; the rate falls from the first to the second of ``rates``."""
    tiles, width, mass, share = _STEP // _TILE, _TILE + 2 * window, np.cumsum(noise_w), np.float32(negatives / _SHARED)
    around = -2 - np.arange(2 * window + _STEP)  # places outside the text: documents of their own
    ids = np.concatenate([np.zeros(window, ids.dtype), ids, np.zeros(window + _STEP, ids.dtype)])
    doc = np.concatenate([around[:window], doc, around[window:]])
    apart = np.abs(np.arange(width) - window - np.arange(_TILE)[:, None])
    band = (apart > 0) & (apart <= window)
    starts = rng.permutation(np.arange(0, len(ids) - 2 * window - _STEP, _STEP))
    for s, at in enumerate(starts):
        rate = np.float32(rates[0] + (rates[1] - rates[0]) * s / len(starts))
        c_ids, o_ids = ids[at + window:at + window + _STEP], ids[at:at + _STEP + 2 * window]
        drawn = np.searchsorted(mass, rng.random(_SHARED) * mass[-1], side="right").clip(max=len(mass) - 1)
        w, c, noise = word.take(c_ids, 0), context.take(o_ids, 0), context.take(drawn, 0)
        wt, ct = w.reshape(tiles, _TILE, -1), _tiles(c, tiles, width)
        pairs = band & (doc[at + window:at + window + _STEP].reshape(tiles, _TILE, 1) == _tiles(doc[at:at + _STEP + 2 * window], tiles, width)[:, None])
        up = 1.0 - wordvec._sigmoid(wt @ ct.transpose(0, 2, 1))
        up *= pairs
        c_pairs = pairs.sum(2, dtype=np.float32).ravel()
        down = wordvec._sigmoid(w @ noise.T)
        down *= (share * c_pairs)[:, None]
        pulled = (up @ ct).reshape(w.shape) - down @ noise
        pushed, o_pairs = np.zeros_like(c), np.zeros(len(o_ids), np.float32)
        for total, part in ((pushed, up.transpose(0, 2, 1) @ wt), (o_pairs, pairs.sum(1, dtype=np.float32))):
            total[:_STEP].reshape(tiles, _TILE, *total.shape[1:])[...] += part[:, :_TILE]
            for i in range(_TILE, width):  # the rows that a tile shares with those after it
                total[i:i + _STEP - _TILE + 1:_TILE] += part[:, i]
        _add(word, c_ids, pulled, c_pairs, rate)
        weight = np.full(_SHARED, share * c_pairs.sum(), np.float32)
        _add(context, np.concatenate([o_ids, drawn]), np.concatenate([pushed, -(down.T @ w)]), np.concatenate([o_pairs, weight]), rate)


def _update(turn: int, passes: int, dim: int, seed: int, window: int, negatives: int, rate: float):
    """A block and the vectors of its known terms -> their vectors after one pass over the block, without a context after the last."""
    def update(left: pa.Table, right: pa.Table) -> pa.Table:
        by = np.argsort(right.column("place").to_numpy())
        place, tid, count = (right.column(x).to_numpy()[by] for x in ("place", "tid", "n_tokens"))
        both = wordvec.first_vectors(tid, dim, seed) if turn == 1 else lda._rows(right.column("vec"), 2 * dim, np.float32)[by]
        word, context = np.ascontiguousarray(both[:, :dim]), np.ascontiguousarray(both[:, dim:])
        block = left.column("block")[0].as_py()
        if len(tid):
            row = np.full(len(left.column("terms")[0]), -1)
            row[place] = np.arange(len(place))
            ids = row[np.frombuffer(left.column("codes")[0].as_py(), np.int32)]
            doc = np.searchsorted(np.frombuffer(left.column("ends")[0].as_py(), np.int64), np.arange(len(ids)), side="right")
            falls = [max(1.0 - t / passes, 1e-4) * rate for t in (turn - 1, turn)]
            train(word, context, ids[ids >= 0], doc[ids >= 0], count.astype(np.float64) ** 0.75, np.random.default_rng([seed, turn, block]), falls, window, negatives)
        out = word if turn == passes else np.concatenate([word, context], 1)  # nothing reads the last context vectors
        return pa.table({"tid": pa.array(tid, pa.int64()), "block": pa.array(np.full(len(tid), block, np.int64)),
                         "vec": lda._bytes(out, np.float32), "n": pa.array(np.ones(len(tid), np.int64))})
    return update


def word_vectors(df: DataFrame, tokens: str, dim: int, min_count: int, seed: int, passes: int, window: int = 5, negatives: int = 5,
                 rate: float = 0.025) -> DataFrame:
    """(word, vector) of every term that occurs ``min_count`` times, after ``passes`` over all documents of ``df``."""
    blocks = materialize(df.select(tokens).mapInArrow(pack, "block long, terms array<string>, n array<long>, codes binary, ends binary"))
    parts = blocks.count()
    counts = blocks.select(F.inline(F.arrays_zip("terms", "n"))).groupBy(F.col("terms").alias("term")).agg(F.sum("n").alias("n_tokens"))
    terms = materialize(counts.where(F.col("n_tokens") >= min_count))
    if terms.isEmpty():
        raise IllegalArgumentException("The vocabulary size should be > 0. You may need to check the setting of minCount.")
    terms = materialize(lda.term_ids(terms).join(terms, "term"))
    places = blocks.select(F.col("block").alias("nblock"), F.posexplode("terms").alias("place", "term"))
    needs = materialize(places.join(terms, "term").select("nblock", "place", "tid", "n_tokens"))
    tasks, weights = 4 * parts, None  # more tasks than blocks, so that few blocks meet in one
    for turn in range(1, passes + 1):
        vecs = needs.join(weights, "tid") if weights else needs
        new = (blocks.repartition(tasks, "block").groupBy("block").cogroup(vecs.repartition(tasks, "nblock").groupBy("nblock"))
               .applyInArrow(_update(turn, passes, dim, seed, window, negatives, rate), "tid long, block long, vec binary, n long"))
        mean = wordvec._sum_terms(True, dim if turn == passes else 2 * dim, np.float32)
        new = new.repartition("tid").sortWithinPartitions("tid", "block").mapInArrow(mean, "tid long, vec binary")
        weights = materialize(new)

    def unpack(batches):
        for b in batches:
            m = lda._rows(b.column(1), dim, np.float32)
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(m) + 1) * dim, pa.int32()), pa.array(m.ravel(), pa.float32()))
            yield pa.RecordBatch.from_arrays([b.column(0), lists], names=["word", "vector"])
    return terms.join(weights, "tid").select("term", "vec").mapInArrow(unpack, "word string, vector array<float>")
