"""Exact copies by skew-safe combining: inside a piece, then in salted groups, then over the salts.

Texts are equal when they are the same after every blank is taken out. A digest only brings texts
together; at every stage whole contents are compared, so that unequal texts with one digest stay
apart. A digest that a single local group holds has nothing to be compared with, so its text never
moves. Of a digest that several hold, each content moves once a local group, to one of so many
salts that a salted group holds about ``target_bytes``. The winners of the salts meet in further
rounds, each of as few of them as again fit.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from riskweave.llm.common import free_name, stored
from riskweave.llm.pieces import ROW_BITS, Piece, cut

BLANK_BYTES = b" \t\n\x0b\x0c\r"
#: Bytes of contents that one salted group may hold (a single text may be longer).
TARGET_BYTES = 4 << 20
#: What a content counts besides its bytes, and the most winners that meet in one group of a round.
ROW_BYTES, MOST_WINNERS = 64, 64


def sha256(content: bytes) -> bytes:
    return hashlib.sha256(content).digest()


class Local:
    """The groups of equal texts in one piece, in the order of their first documents (slots)."""

    def __init__(self, piece: Piece, digest: Callable[[bytes], bytes]):
        raw, ends = piece.body.tobytes(), piece.ends.tolist()
        letters = np.concatenate([[0], np.cumsum((piece.body & 0xC0) != 0x80)])
        self.chars = np.diff(letters[piece.ends], prepend=0) - 1  # without the line feed
        self.slot = np.zeros(len(ends), np.int64)
        self.digests: dict[int, bytes] = {}
        self.bytes: dict[int, int] = {}
        known: dict[bytes, list[tuple[int, bytes]]] = {}
        at = 0
        for i, end in enumerate(ends):
            content = raw[at : end - 1].translate(None, BLANK_BYTES)
            at = end
            mark = digest(content)
            alike = known.setdefault(mark, [])
            slot = next((s for s, body in alike if body == content), None)
            if slot is None:
                slot = i
                alike.append((i, content))
                self.digests[i], self.bytes[i] = mark, len(content)
            self.slot[i] = slot

    def best(self, piece: Piece, keys: list) -> dict[int, tuple]:
        """For each slot the row that stays: most code points, least key (null last), first row."""
        out: dict[int, tuple] = {}
        for i, (slot, n, key) in enumerate(zip(self.slot.tolist(), self.chars.tolist(), keys, strict=True)):
            held = out.get(slot)
            rank = (-n, key is None, 0 if key is None else key)
            if held is None or rank < held[0]:
                out[slot] = rank, key, piece.id << ROW_BITS | i
        return out


def exact_copies(
    docs: DataFrame,
    key: str = "doc_id",
    text: str = "text",
    carry_text: bool = True,
    target_bytes: int = TARGET_BYTES,
    digest: Callable[[bytes], bytes] = sha256,
) -> DataFrame:
    """Which rows have equal texts, and which of them stays.

    Returns the columns of ``docs`` (the text only with ``carry_text``) and ``keep_key`` (the key of
    the row that stays), ``group_size``, ``kept`` and ``digest`` (of the text without blanks; all
    with underscores before a name that is taken). Of equal texts the row with the most code points
    in the text as given stays, then that with the least key (a null key is the last), then one row.

    A null text counts as empty (and stays null), blank texts are equal to it. Repeated rows are
    rows of their own, of which one stays. A text of any length is compared whole; one text has to
    fit in a task's memory. An empty table gives an empty table.
    """
    others = [f for f in docs.schema.fields if f.name != text]
    absent = free_name("absent", docs.columns)
    pieces = cut(docs.withColumn(absent, F.col(text).isNull()), text)
    place = next(i for i, f in enumerate(others) if f.name == key)
    best = T.StructType(
        [
            T.StructField("less", T.LongType()),
            T.StructField("none", T.BooleanType()),
            T.StructField("key", others[place].dataType),
            T.StructField("uid", T.LongType()),
        ]
    )
    groups = T.StructType(
        [
            T.StructField("piece", T.LongType()),
            T.StructField("slot", T.IntegerType()),
            T.StructField("digest", T.BinaryType()),
            T.StructField("size", T.LongType()),
            T.StructField("n", T.LongType()),
            T.StructField("best", best),
        ]
    )

    def combine(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                piece = Piece(batch, i)
                local = Local(piece, digest)
                stays = local.best(piece, piece.rows.field(place).to_pylist())
                slots = list(stays)
                kept = zip(*[(rank[0], rank[1], k, uid) for rank, k, uid in stays.values()], strict=True)
                keys = piece.rows.field(place).type
                kinds = (pa.int64(), pa.bool_(), keys, pa.int64())
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([piece.id] * len(slots), pa.int64()),
                        pa.array(slots, pa.int32()),
                        pa.array([local.digests[s] for s in slots], pa.binary()),
                        pa.array([local.bytes[s] for s in slots], pa.int64()),
                        pa.array(np.bincount(local.slot)[slots].astype(np.int64)),
                        pa.StructArray.from_arrays(
                            [pa.array(x, k) for x, k in zip(kept, kinds, strict=True)], names=best.fieldNames()
                        ),
                    ],
                    names=groups.fieldNames(),
                )

    local = stored(pieces.mapInArrow(combine, groups), "copies_local")

    # Digests of several local groups, and how their contents are dealt.
    weight = F.col("size") + ROW_BYTES
    fits = F.floor(F.lit(target_bytes) / F.avg(weight))
    several = (
        local.groupBy("digest")
        .agg(
            F.count("*").alias("held"),
            F.ceil(F.sum(weight) / target_bytes).alias("wide"),
            F.greatest(F.lit(2), F.least(F.lit(MOST_WINNERS), fits)).cast("long").alias("fan"),
        )
        .where("held > 1")
        .select("digest", F.least("held", "wide").alias("salts"), "fan")
    )
    salt = F.pmod(F.xxhash64("piece", "slot"), F.col("salts"))
    wanted = stored(local.join(several, "digest").withColumn("salt", salt), "copies_wanted")

    asked = wanted.groupBy("piece").agg(
        F.collect_list(F.struct("slot", "digest", "salts", "fan", "salt", "n", "best")).alias("wanted")
    )
    sends = T.StructType(
        [f for f in wanted.schema.fields if f.name in ("digest", "salts", "fan", "salt", "n", "best", "piece", "slot")]
        + [T.StructField("body", T.BinaryType())]
    )

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                piece, rows = Piece(batch, i), batch.column("wanted")[i].values
                begin = np.concatenate([[0], piece.ends[:-1]])
                slots = rows.field("slot").to_pylist()
                bodies = [piece.body[begin[s] : piece.ends[s] - 1].tobytes().translate(None, BLANK_BYTES) for s in slots]
                held = {
                    **{rows.type.field(j).name: rows.field(j) for j in range(rows.type.num_fields)},
                    "piece": pa.array([piece.id] * len(slots), pa.int64()),
                    "body": pa.array(bodies, pa.binary()),
                }
                yield pa.RecordBatch.from_arrays([held[n] for n in sends.fieldNames()], names=sends.fieldNames())

    sent = pieces.join(asked, "piece").mapInArrow(send, sends)

    # Salted groups, then rounds over the salts; contents are keys, so they are compared whole.
    def merged(rows: DataFrame) -> DataFrame:
        total = rows.groupBy("digest", "salts", "fan", "salt", "body")
        return stored(total.agg(F.sum("n").alias("n"), F.min("best").alias("best")), "copies_merged")

    now = merged(sent)
    settled = now.where("salts = 1")
    while not now.where("salts > 1").isEmpty():
        fewer = now.where("salts > 1").withColumn("salt", F.floor(F.col("salt") / F.col("fan")))
        now = merged(fewer.withColumn("salts", F.ceil(F.col("salts") / F.col("fan"))))
        settled = settled.unionByName(now.where("salts = 1"))

    # What each local group learns. Unequal contents under one digest are told apart by content.
    clash = settled.groupBy("digest").count().where("count > 1").select("digest")
    learned = ["piece", "slot", F.col("total.n").alias("n"), F.col("total.best").alias("best")]
    known = settled.join(clash, "digest", "left_anti").alias("total")
    answers = wanted.alias("w").join(known, "digest").select(*learned)
    if not clash.isEmpty():
        apart = sent.join(clash, "digest", "left_semi").drop("n", "best")
        whole = settled.select("digest", "body", "n", "best").alias("total")
        answers = answers.unionByName(apart.join(whole, ["digest", "body"]).select(*learned))
    told = answers.groupBy("piece").agg(F.collect_list(F.struct("slot", "n", "best")).alias("told"))

    names = [n for n in docs.columns if carry_text or n != text]
    added = [free_name(n, docs.columns) for n in ("keep_key", "group_size", "kept", "digest")]
    kinds = [others[place].dataType, T.LongType(), T.BooleanType(), T.BinaryType()]
    schema = T.StructType(
        [T.StructField(n, docs.schema[n].dataType) for n in names]
        + [T.StructField(n, k) for n, k in zip(added, kinds, strict=True)]
    )

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                piece, rows = Piece(batch, i), batch.column("told")[i]
                local = Local(piece, digest)
                own = local.best(piece, piece.rows.field(place).to_pylist())
                sizes = np.bincount(local.slot, minlength=len(local.slot))
                stays = {s: (k, uid) for s, (_, k, uid) in own.items()}
                totals = {s: int(sizes[s]) for s in own}
                for told_row in rows.as_py() or ():
                    slot = told_row["slot"]
                    stays[slot] = told_row["best"]["key"], told_row["best"]["uid"]
                    totals[slot] = told_row["n"]
                slots = local.slot.tolist()
                columns = dict(zip((f.name for f in others), piece.carried(len(others)), strict=True))
                if carry_text:
                    raw, begin = piece.body.tobytes(), [0, *piece.ends[:-1].tolist()]
                    gone = piece.rows.field(len(others)).to_pylist()
                    texts = [None if no else raw[a : b - 1] for a, b, no in zip(begin, piece.ends.tolist(), gone, strict=True)]
                    columns[text] = pa.array(texts, pa.binary()).cast(pa.string())
                out = [columns[n] for n in names]
                out += [
                    pa.array([stays[s][0] for s in slots], piece.rows.field(place).type),
                    pa.array([totals[s] for s in slots], pa.int64()),
                    pa.array([stays[s][1] == piece.id << ROW_BITS | j for j, s in enumerate(slots)], pa.bool_()),
                    pa.array([local.digests[s] for s in slots], pa.binary()),
                ]
                yield pa.RecordBatch.from_arrays(out, names=schema.fieldNames())

    return pieces.join(told, "piece", "left").mapInArrow(finish, schema)


def drop_exact_copies(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows that stay, as they were."""
    mark = free_name("kept", docs.columns)
    return exact_copies(docs, key, text).where(F.col(mark)).select(*docs.columns)
