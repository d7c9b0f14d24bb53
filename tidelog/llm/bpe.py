"""Operator 2: byte-level BPE encoding and decoding by recursive SQL.

Each task splits its texts by the tokenizer's pattern and gives the distinct pieces
to an in-process DuckDB. There a piece is rows (piece, position, token), at first one
for each byte. A recursive query joins neighbouring rows with the merge table, takes
each piece's pair of least rank, the leftmost of equals, and contracts it, until no
piece has a pair that merges. Decoding joins token rows with the vocabulary and
concatenates their bytes in order. A piece that is a token by itself is that token.
Pieces don't depend on each other, so a text's ids are those of its pieces in turn.

A recursion keeps the rows of all its turns. Pieces of up to LONG bytes are encoded in parts whose rows
over all turns are bounded by ROWS. A longer piece contracts the leftmost disjoint places of its least
rank in one turn, up to the first that makes a pair of smaller rank, which is the same as one after the
other; its recursion ends after the turns that ROWS allow and goes on from its last rows, so memory is
linear in the longest piece.

A null text is an empty one: no ids and no bytes. Any text is encodable, whatever its length. A task keeps at
most ``KEEP`` pieces between batches, less after some that are very long. Ids that the vocabulary lacks fail to
decode. Repeated rows are encoded each; there are no ties but equal ranks, of which the leftmost goes first.
Only the key and the text are read, so other columns may have any names.
"""

from __future__ import annotations

import base64
import hashlib
import itertools
from collections import defaultdict
from collections.abc import Callable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .text import BEYOND, LATIN, by_slice

KEEP = 250_000
PART = 60_000  # pieces to a recursive query
LONG = 64  # bytes of a piece that is encoded with others, one pair a turn
ROWS = 4_000_000  # of a recursive query over all turns


def load_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


def splitter(pattern: str) -> Callable[[str], list[str]]:
    import regex

    whole = regex.compile(pattern.replace(r"[^\s\p{L}\p{N}]", r"[^\p{White_Space}\p{L}\p{N}]").replace(r"\s+(?!\S)|\s+", r"\p{White_Space}+(?!\P{White_Space})|\p{White_Space}+"))

    def split(text: str) -> list[str]:
        return (whole if BEYOND.search(text) else LATIN).findall(text)

    return split


class Engine:
    """A DuckDB connection that holds one vocabulary and its merges."""

    def __init__(self, ranks: dict[bytes, int], memory: str = "300MB"):
        import duckdb

        self.ranks = ranks
        self.sql = duckdb.connect(config={"threads": 1, "memory_limit": memory, "temp_directory": "", "preserve_insertion_order": False})
        left, right, merged = [], [], []
        for token, rank in ranks.items():
            for cut in range(1, len(token)):
                a, b = ranks.get(token[:cut]), ranks.get(token[cut:])
                if a is not None and b is not None:
                    left.append(a)
                    right.append(b)
                    merged.append(rank)
        merges = pa.table({"l": pa.array(left, pa.int32()), "r": pa.array(right, pa.int32()), "m": pa.array(merged, pa.int32())})
        vocab = pa.table({"tok": pa.array(list(ranks.values()), pa.int32()), "hex": pa.array([t.hex() for t in ranks], pa.string())})
        self.sql.register("merges_in", merges)
        self.sql.execute("CREATE TABLE merges AS SELECT l::BIGINT * 1048576 + r AS pair, m::BIGINT AS m FROM merges_in")
        self.sql.register("vocab_in", vocab)
        self.sql.execute("CREATE TABLE vocab AS SELECT * FROM vocab_in")
        self.byte = np.array([ranks[bytes([i])] for i in range(256)], np.int32)

    # cell: piece * 2**32 + position, so that one number orders all token rows. A piece leaves
    # the working table once no pair of it merges; its rows of the last turn are its tokens.
    ENCODE = """
        WITH RECURSIVE step(turn, cell, tok) AS (
            SELECT 0, cell, tok FROM bytes_in
            UNION ALL
            (WITH pairs AS (
                SELECT turn, cell, tok, lead(cell) OVER w AS next_cell, lead(tok) OVER w AS next_tok FROM step WINDOW w AS (ORDER BY cell)
             ), best AS (
                SELECT cell >> 32 AS piece, min(m.m * 256 + (cell & 255)) AS b, arg_min(next_cell, m.m * 256 + (cell & 255)) AS eaten
                FROM pairs p JOIN merges m ON m.pair = p.tok::BIGINT * 1048576 + p.next_tok
                WHERE p.next_cell >> 32 = p.cell >> 32 GROUP BY ALL
             )
             SELECT turn + 1, cell, CASE WHEN cell & 4294967295 = b & 255 THEN (b >> 8)::INTEGER ELSE tok END
             FROM step JOIN best ON cell >> 32 = piece WHERE cell <> eaten
            )
        )
        SELECT cell >> 32 AS piece, tok FROM step JOIN (SELECT cell >> 32 AS p, max(turn) AS t FROM step GROUP BY ALL) ON cell >> 32 = p AND turn = t ORDER BY cell
    """
    # One long piece, by position alone. Places of its least rank that follow each other are a run (aaaa), of
    # which every other one, from the left, is contracted; up to the first that makes a pair of smaller rank.
    ENCODE_LONG = """
        WITH RECURSIVE step(turn, cell, tok) AS (
            SELECT 0, cell, tok FROM rows_in
            UNION ALL
            (WITH pairs AS (
                SELECT cell, tok, lead(cell) OVER w AS next_cell, lead(tok) OVER w AS next_tok, lag(cell) OVER w AS last_cell, lag(tok) OVER w AS last_tok, lead(tok, 2) OVER w AS after_tok
                FROM step WHERE turn < {turns} WINDOW w AS (ORDER BY cell)
             ), ranked AS (
                SELECT p.*, m.m FROM pairs p JOIN merges m ON m.pair = p.tok::BIGINT * 1048576 + p.next_tok
             ), least AS (
                SELECT *, lag(next_cell) OVER (ORDER BY cell) IS DISTINCT FROM cell AS begins FROM ranked WHERE m = (SELECT min(m) FROM ranked)
             ), runs AS (
                SELECT *, sum(begins::INT) OVER (ORDER BY cell) AS run, row_number() OVER (ORDER BY cell) AS n FROM least
             ), places AS (
                SELECT * FROM (SELECT *, n - min(n) OVER (PARTITION BY run) AS place FROM runs) WHERE place % 2 = 0
             ), beside AS (
                SELECT cell, next_cell, m, after_tok, CASE WHEN lag(next_cell) OVER (ORDER BY cell) = last_cell THEN m ELSE last_tok END AS before_tok FROM places
             ), made AS (
                SELECT b.cell, b.next_cell, b.m, coalesce(x.m < b.m, false) OR coalesce(y.m < b.m, false) AS lower
                FROM beside b LEFT JOIN merges x ON x.pair = b.before_tok::BIGINT * 1048576 + b.m LEFT JOIN merges y ON y.pair = b.m * 1048576 + b.after_tok
             ), taken AS (
                SELECT cell, next_cell, m FROM made WHERE cell <= coalesce((SELECT min(cell) FROM made WHERE lower), 9223372036854775807)
             )
             SELECT s.turn + 1, s.cell, coalesce(t.m::INTEGER, s.tok) FROM step s LEFT JOIN taken t ON s.cell = t.cell
             WHERE s.turn < {turns} AND EXISTS (FROM taken) AND s.cell NOT IN (SELECT next_cell FROM taken)
            )
        )
        SELECT turn, cell, tok FROM step WHERE turn = (SELECT max(turn) FROM step) ORDER BY cell
    """
    DECODE = "SELECT row, string_agg(hex, '' ORDER BY pos) AS hex, count(hex) AS n FROM tokens_in LEFT JOIN vocab USING (tok) GROUP BY row"

    def encode(self, pieces: list[bytes]) -> list[np.ndarray]:
        """The ids of each piece."""
        out: list[np.ndarray | None] = [None] * len(pieces)
        todo = []
        for i, p in enumerate(pieces):
            rank = self.ranks.get(p)
            if rank is not None:
                out[i] = np.array([rank], np.int32)
            else:
                todo.append(i)
        size = np.array([len(pieces[i]) for i in todo], np.int64)
        for i in np.flatnonzero(size > LONG).tolist():
            out[todo[i]] = self._long(pieces[todo[i]])
        todo, size = [todo[i] for i in np.flatnonzero(size <= LONG).tolist()], size[size <= LONG]
        # A piece has a row for each byte and turn at most.
        cost = np.cumsum(size * size)
        at = 0
        while at < len(todo):
            stop = max(at + 1, min(at + PART, int(np.searchsorted(cost, cost[at] + ROWS, side="right"))))
            part, n = todo[at:stop], size[at:stop]
            at = stop
            which = np.repeat(np.arange(len(part), dtype=np.int64), n)
            pos = np.arange(len(which)) - np.repeat(np.cumsum(n) - n, n)
            rows = pa.table({"cell": which << 32 | pos, "tok": self.byte[np.frombuffer(b"".join(pieces[i] for i in part), np.uint8)]})
            self.sql.register("bytes_in", rows)
            got = self.sql.execute(self.ENCODE).fetchnumpy()
            piece, tok = got["piece"], got["tok"]
            ends = np.searchsorted(piece, np.arange(len(part) + 1))
            for j, i in enumerate(part):
                out[i] = tok[ends[j] : ends[j + 1]]
            self.sql.unregister("bytes_in")
        return out

    def _long(self, piece: bytes) -> np.ndarray:
        cell, tok = np.arange(len(piece), dtype=np.int64), self.byte[np.frombuffer(piece, np.uint8)]
        self.sql.execute(f"SET memory_limit = '{max(300, len(piece) // 2000)}MB'")
        done = False
        while not done:
            turns = max(1, ROWS // len(cell))
            self.sql.register("rows_in", pa.table({"cell": cell, "tok": tok}))
            got = self.sql.execute(self.ENCODE_LONG.format(turns=turns)).fetchnumpy()
            self.sql.unregister("rows_in")
            cell, tok, done = got["cell"], got["tok"], int(got["turn"][0]) < turns
        self.sql.execute("SET memory_limit = '300MB'")
        return tok

    def decode(self, rows: list[np.ndarray]) -> list[bytes]:
        """The bytes of each row of ids."""
        size = np.array([len(r) for r in rows], np.int64)
        flat = np.concatenate(rows) if len(rows) and size.sum() else np.empty(0, np.int32)
        which = np.repeat(np.arange(len(rows)), size)
        self.sql.register("tokens_in", pa.table({"row": which, "pos": np.arange(len(flat)), "tok": flat.astype(np.int32)}))
        got = self.sql.execute(self.DECODE).fetchall()
        self.sql.unregister("tokens_in")
        out = [b""] * len(rows)
        for row, text, n in got:
            if n != size[row]:
                raise ValueError("an id is not in the vocabulary")
            out[row] = bytes.fromhex(text)
        return out


class Coder:
    """Encodes and decodes texts through the pieces it has met."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        self.engine, self.split = Engine(ranks), splitter(pattern)
        self.forget()

    def forget(self) -> None:
        self.long = False
        self.number = defaultdict(itertools.count().__next__)
        self.ids: list[np.ndarray] = []
        self.joined: list[str] = []
        self.bytes: list[bytes] = []

    def learn(self, texts: list[str]) -> list[np.ndarray]:
        """The piece numbers of each text; pieces met for the first time are encoded and decoded."""
        if len(self.number) > KEEP or self.long:
            self.forget()
        of = self.number.__getitem__
        out = []
        for t in texts:
            pieces = self.split(t)
            out.append(np.fromiter(map(of, pieces), np.int32, len(pieces)))
        fresh = [p.encode() for p in itertools.islice(self.number, len(self.ids), None)]
        self.long = sum(len(p) for p in fresh if len(p) > LONG) > KEEP
        ids = self.engine.encode(fresh)
        for at in range(0, len(ids), PART):
            self.bytes += self.engine.decode(ids[at : at + PART])
        self.ids += ids
        self.joined += [" ".join(map(str, i.tolist())) for i in ids]
        return out

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        return [np.concatenate([self.ids[i] for i in n]) if len(n) else np.empty(0, np.int32) for n in self.learn(texts)]


def _coder(path: str, pattern: str) -> Callable[[], Coder]:
    """One coder for each Python worker and vocabulary."""
    kept = globals().setdefault("_coders", {})

    def get() -> Coder:
        if (path, pattern) not in kept:
            kept[path, pattern] = Coder(load_ranks(path), pattern)
        return kept[path, pattern]

    return get


def encode(docs: DataFrame, path: str, pattern: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key and ids: array<int>."""

    def make(batch: pa.RecordBatch) -> pa.RecordBatch:
        ids = _coder(path, pattern)().encode(pc.fill_null(batch.column("text"), "").to_pylist())
        return pa.record_batch([batch.column("key"), pa.array(ids, pa.list_(pa.int32()))], names=["key", "ids"])

    kind = docs.schema[key].dataType.simpleString()
    return docs.select(F.col(key).alias("key"), F.col(text).alias("text")).mapInArrow(by_slice("text", make), f"key {kind}, ids array<int>").withColumnRenamed("key", key)


def decode(rows: DataFrame, path: str, pattern: str, key: str = "doc_id", ids: str = "ids") -> DataFrame:
    """key and bytes: binary; a null list is an empty one."""

    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                got = _coder(path, pattern)().engine.decode([np.array(r or [], np.int32) for r in part.column("ids").to_pylist()])
                yield pa.record_batch([part.column("key"), pa.array(got, pa.binary())], names=["key", "bytes"])

    kind = rows.schema[key].dataType.simpleString()
    return rows.select(F.col(key).alias("key"), F.col(ids).alias("ids")).mapInArrow(run, f"key {kind}, bytes binary").withColumnRenamed("key", key)


def digests(docs: DataFrame, path: str, pattern: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, n_tokens, ids_sha256 of the decimal ids joined by spaces, decoded_sha256 of the decoded bytes."""

    def make(batch: pa.RecordBatch) -> pa.RecordBatch:
        coder = _coder(path, pattern)()
        n, ids, back = [], [], []
        for numbers in coder.learn(pc.fill_null(batch.column("text"), "").to_pylist()):
            numbers = numbers.tolist()
            line = " ".join(map(coder.joined.__getitem__, numbers))
            n.append(line.count(" ") + 1 if line else 0)
            ids.append(hashlib.sha256(line.encode()).hexdigest())
            back.append(hashlib.sha256(b"".join(map(coder.bytes.__getitem__, numbers))).hexdigest())
        return pa.record_batch([batch.column("key"), pa.array(n, pa.int64()), pa.array(ids), pa.array(back)], names=["key", "n_tokens", "ids_sha256", "decoded_sha256"])

    kind = docs.schema[key].dataType.simpleString()
    rows = docs.select(F.col(key).alias("key"), F.col(text).alias("text"))
    return rows.mapInArrow(by_slice("text", make, 8_000_000), f"key {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string").withColumnRenamed("key", key)
