"""Operator 11, exact dedup: a tree-merge of sorted digest runs.

Each input partition becomes sorted runs of (SHA-256, doc_id), in which equal digests are merged at
once. Runs are then exchanged in rounds between ``fan ** rounds`` nodes. In a round a node cuts its
run by the next digit of the digest's place and sends a piece to each of the ``fan - 1`` nodes that
differ from it in that digit, so over the rounds the runs of one digest range climb a (``fan``-nomial)
tree, while all ranges climb at once: no node ever holds more than its share, and a round has ``fan``
pieces a node. At every level a node merges its pieces, compares equal digests over all 256 bits,
and retains one identifier and a count a digest. The answers go down the same tree, piece by piece,
to the runs they came from. A digest that a third of all rows have is one entry a run on the whole
way, never a hot key, and no row or text is shuffled.

Rows: null texts count as empty. Of equal texts one row stays, that of the largest (or smallest)
doc_id; rows without an id stay only where no row of the text has one. Of rows equal in id and text
exactly one stays, whichever of them. Other columns are ignored; no rows give no rows.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from helixmill.llm import common as C

RUN = "run long, digests binary, present binary, ids binary"
PIECE = "to long, src long, digests binary, present binary, ids binary, counts binary"
ANSWER = "src long, piece long, present binary, ids binary, counts binary, first binary"
VERDICT = "doc_id long, keep_id long, group_size long, kept boolean, digest binary"


def tree_shape(width: int, fan: int = 8) -> tuple[int, int]:
    """(fan, rounds) of the tree with ``width`` nodes at least: as few rounds as ``fan`` allows, then as small a fan."""
    rounds = max(1, math.ceil(math.log(width) / math.log(fan) - 1e-9)) if width > 1 else 1
    while fan > 2 and (fan - 1) ** rounds >= width:
        fan -= 1
    return fan, rounds


def words(digests: np.ndarray) -> np.ndarray:
    """(n, 4) numbers that order as the 32-byte digests do."""
    return digests.reshape(-1, 32).view(">u8").astype(np.uint64)


def merge_runs(key: np.ndarray, present: np.ndarray, ids: np.ndarray, counts: np.ndarray):
    """Merge entries (digest, identifier or none, count), given run by run.

    Returns the order that sorts them, the merged entry of each sorted one, each merged entry's first
    sorted one, the entry that it retains (largest identifier, none lowest) and its count. Digests
    are one only if all 256 bits are.
    """
    order = np.argsort(key[:, 0], kind="stable")
    near = key[order]
    same = (near[1:] == near[:-1]).all(1)
    if ((near[1:, 0] == near[:-1, 0]) & ~same).any():
        order = np.lexsort((key[:, 3], key[:, 2], key[:, 1], key[:, 0]))
        near = key[order]
        same = (near[1:] == near[:-1]).all(1)
    first = np.concatenate([[True], ~same]) if len(key) else np.zeros(0, bool)
    group, starts = np.cumsum(first) - 1, np.flatnonzero(first)
    best = np.lexsort((ids[order], present[order], group))
    kept = order[best[np.append(starts[1:], len(order)) - 1]] if len(order) else order
    return order, group, starts, kept, np.add.reduceat(counts[order], starts) if len(order) else counts


def _place(head: np.ndarray, nodes: int) -> np.ndarray:
    """The node at which a digest ends; it grows with the digest."""
    return (((head >> np.uint64(32)) * np.uint64(nodes)) >> np.uint64(32)).astype(np.int64)


def _pieces(node: int, source: int, level: int, fan: int, rounds: int, key, digests, present, ids, counts) -> list[tuple]:
    """Rows of PIECE: a sorted run of ``node``, cut by the digit of this level."""
    unit = fan ** (rounds - level)
    digit = _place(key[:, 0], fan**rounds) // unit % fan
    cut = np.flatnonzero(np.diff(digit, prepend=-1))
    ends = np.append(cut[1:], len(digit))
    out = []
    for a, b in zip(cut.tolist(), ends.tolist()):
        to = node + (int(digit[a]) - node // unit % fan) * unit
        out.append((to, source, digests[a:b].tobytes(), present[a:b].tobytes(), ids[a:b].tobytes(), counts[a:b].tobytes()))
    return out


def _table(rows: list[tuple], schema: str) -> pa.Table:
    names, kinds = zip(*[c.split() for c in schema.split(", ")])
    types = {"long": pa.int64(), "binary": pa.binary(), "boolean": pa.bool_()}
    columns = list(zip(*rows)) if rows else [[] for _ in names]
    return pa.table({n: pa.array(c, types[k]) for n, k, c in zip(names, kinds, columns)})


def _load(table: pa.Table):
    """Pieces of one node in the order of their sources: sources, lengths, digest numbers, bytes, identifiers, counts."""
    table = table.take(pa.array(np.argsort(C.ints(table["src"]), kind="stable")))
    join = lambda name, kind: np.concatenate([np.zeros(0, kind), *C.blobs(table[name], kind)])
    digests = join("digests", np.uint8).reshape(-1, 32)
    sizes = [len(x) for x in C.blobs(table["present"], np.uint8)]
    return C.ints(table["src"]), sizes, words(digests), digests, join("present", np.uint8), join("ids", np.int64), join("counts", np.int64)


def runs_of(docs: DataFrame, id_col: str, text: Column, keep: str, run_rows: int) -> DataFrame:
    """(run, digests, present, ids): sorted runs of at most ``run_rows`` rows of one input partition."""
    flip = keep == "smallest"

    def cut(batches):
        part, seq, have = TaskContext.get().partitionId(), 0, []

        def run(rows):
            nonlocal seq
            ids = C.ints(rows["id"], null=0)
            present = np.asarray(rows["id"].is_valid()).astype(np.uint8)
            digests = np.frombuffer(b"".join(rows["digest"].to_pylist()), np.uint8).reshape(-1, 32)
            order = np.lexsort(words(digests).T[::-1])
            row = (part + (seq << 32), digests[order].tobytes(), present[order].tobytes(), (~ids if flip else ids)[order].tobytes())
            seq += 1
            return _table([row], RUN).to_batches()

        for b in batches:
            have.append(b)
            if sum(x.num_rows for x in have) >= run_rows:
                yield from run(pa.Table.from_batches(have))
                have = []
        if sum(x.num_rows for x in have):
            yield from run(pa.Table.from_batches(have))

    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.unhex(F.sha2(F.coalesce(text.cast("string"), F.lit("")).cast("binary"), 256)).alias("digest"))
    return rows.mapInArrow(cut, RUN)


def copy_groups(
    docs: DataFrame, keep: str = "largest", normalise=None, fan: int = 8, run_rows: int = 1 << 18, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """(doc_id, keep_id, group_size, kept, digest) of every row. ``normalise``: what makes texts equal, a function of the text's Column."""
    if keep not in ("largest", "smallest"):
        raise ValueError("keep: largest or smallest")
    flip = keep == "smallest"
    fan, rounds = tree_shape(C.shuffle_width(docs.sparkSession), fan)
    text = normalise(F.col(text_col)) if normalise else F.col(text_col)
    runs = C.materialize(runs_of(docs, id_col, text, keep, run_rows), "digest-runs")

    def local(table: pa.Table):
        digests = C.blobs(table["digests"], np.uint8)[0].reshape(-1, 32)
        present, ids = C.blobs(table["present"], np.uint8)[0], C.blobs(table["ids"], np.int64)[0]
        return digests, present, ids, merge_runs(words(digests), present, ids, np.ones(len(ids), np.int64))

    def send(batches):
        for b in batches:
            for i in range(b.num_rows):
                one = pa.Table.from_batches([b.slice(i, 1)])
                digests, present, ids, (_, _, _, kept, counts) = local(one)
                run = one["run"][0].as_py()
                yield from _table(_pieces(run % fan**rounds, run, 1, fan, rounds, words(digests[kept]), digests[kept], present[kept], ids[kept], counts), PIECE).to_batches()

    def climb(level):
        def merge(key, table):
            _, _, key_, digests, present, ids, counts = _load(table)
            _, _, _, kept, total = merge_runs(key_, present, ids, counts)
            node = key[0].as_py()
            return _table(_pieces(node, node, level, fan, rounds, key_[kept], digests[kept], present[kept], ids[kept], total), PIECE)

        return merge

    def answer(key, table: pa.Table, above: pa.Table | None) -> pa.Table:
        """What a node tells the sources of its pieces; ``above``: what it was told itself, None at the top."""
        src, sizes, key_, _, present, ids, counts = _load(table)
        order, group, starts, kept, total = merge_runs(key_, present, ids, counts)
        if above is None:
            keep_present, keep_ids, flag = present[kept], ids[kept], np.ones(len(kept), np.uint8)
        else:
            keep_present, keep_ids, total, flag = _told(above)
        of = np.empty(len(order), np.int64)
        of[order] = group
        first = np.zeros(len(order), np.uint8)
        first[kept] = flag
        ends = np.cumsum(sizes)
        return _table(
            [
                (s, key[0].as_py(), keep_present[of[b - n : b]].tobytes(), keep_ids[of[b - n : b]].tobytes(), total[of[b - n : b]].tobytes(), first[b - n : b].tobytes())
                for s, n, b in zip(src.tolist(), sizes, ends.tolist())
            ],
            ANSWER,
        )

    def tell(key, run: pa.Table, above: pa.Table) -> pa.Table:
        digests, present, ids, (order, group, _, kept, _) = local(run)
        keep_present, keep_ids, total, flag = _told(above)
        of = np.empty(len(order), np.int64)
        of[order] = group
        stays = np.zeros(len(order), bool)
        stays[kept] = flag.astype(bool)
        own, keeps = (~ids, ~keep_ids) if flip else (ids, keep_ids)
        return pa.table(
            {
                "doc_id": pa.array(own, mask=present == 0), "keep_id": pa.array(keeps[of], mask=keep_present[of] == 0), "group_size": pa.array(total[of]),
                "kept": pa.array(stays), "digest": pa.FixedSizeBinaryArray.from_buffers(pa.binary(32), len(ids), [None, pa.py_buffer(digests.tobytes())]).cast(pa.binary()),
            }
        )

    levels = [C.materialize(runs.mapInArrow(send, PIECE), "digest-pieces-1")]
    for level in range(2, rounds + 1):
        levels.append(C.materialize(levels[-1].groupBy("to").applyInArrow(climb(level), PIECE), f"digest-pieces-{level}"))
    told = levels[-1].groupBy("to").applyInArrow(lambda key, table: answer(key, table, None), ANSWER)
    for pieces in levels[-2::-1]:
        told = pieces.groupBy("to").cogroup(told.groupBy("src")).applyInArrow(answer, ANSWER)
    return runs.groupBy("run").cogroup(told.groupBy("src")).applyInArrow(tell, VERDICT)


def _told(table: pa.Table):
    """The answers for a node's run: they came by piece, and pieces are consecutive ranges of it."""
    table = table.take(pa.array(np.argsort(C.ints(table["piece"]), kind="stable")))
    join = lambda name, kind: np.concatenate([np.zeros(0, kind), *C.blobs(table[name], kind)])
    return join("present", np.uint8), join("ids", np.int64), join("counts", np.int64), join("first", np.uint8)


def drop_copies(docs: DataFrame, keep: str = "largest", normalise=None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` without the copies: one row of each text, with all its columns."""
    text = normalise(C.named(text_col)) if normalise else C.named(text_col)
    digest, same = C.unused(docs, "digest"), C.unused(docs, "same_id")
    rows = docs.withColumns({digest: F.sha2(F.coalesce(text.cast("string"), F.lit("")).cast("binary"), 256), same: C.named(id_col).cast("long")})
    stay = copy_groups(docs, keep, normalise, id_col=id_col, text_col=text_col).where("kept").select(F.col("doc_id").alias("_id"), F.lower(F.hex("digest")).alias("_digest"))
    rows = rows.join(stay, (F.col(digest) == F.col("_digest")) & F.col(same).eqNullSafe(F.col("_id")), "left_semi")
    return rows.dropDuplicates([digest, same]).select(*map(C.named, docs.columns))


def query(spark, sf_dir: str) -> DataFrame:
    """op11: of equal texts of ``documents`` the row with the largest doc_id stays."""
    out = copy_groups(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return out.select("doc_id", "keep_id", "group_size", "kept", F.lower(F.hex("digest")).alias("text_sha256"))


ORACLE_SQL = """
select doc_id, max(doc_id) over w as keep_id, count(*) over w as group_size,
  row_number() over (partition by coalesce(text, '') order by doc_id desc nulls last) = 1 as kept, sha256(coalesce(text, '')) as text_sha256
from documents window w as (partition by coalesce(text, ''))
"""
