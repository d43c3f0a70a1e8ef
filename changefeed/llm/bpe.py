"""Byte-level BPE encoding and decoding by recursive queries inside the tasks.

Spark hands out the rows; each task cuts its texts into words by the public pattern and gives words it
has not met to an embedded SQL engine, which keeps one row for each token and position. Each step of the
recursion joins neighbouring tokens with the merge table, takes the leftmost pair of the least rank
in every word and contracts it; words without a pair drop out, until none is left. Words of more than
``LONG`` bytes take a form of the recursion that contracts, in one step, every place of the least rank in
the word, leftmost first where places overlap, and stops after so many steps that the rows it holds stay
bounded; it goes on from the state it reached. A rank whose token forms a pair of a smaller rank with any
neighbour (``alone``) is contracted one place a step, so that both forms give the same ids.
Decoding takes the rows of the vocabulary, an Arrow column, in the order of the ids.

Encoded words are remembered by the worker, at most ``MEMORY`` and those of the round at hand; beyond, it keeps
those met again since (``common.Memory``). Only speed depends on that.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator
from operator import itemgetter

import duckdb
import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from changefeed.llm.common import Memory, worker_cache
from changefeed.llm.pieces import cut

WORDS_A_QUERY = 5000
SQUARES_A_QUERY = 6_000_000
LONG = 256
ROWS_OF_LONG = 2_000_000
MEMORY = 600_000
CHARACTERS_A_ROUND = 6_000_000

CONTRACT = """
with recursive step(k, w, p, n, id, r) as (
    select 0, w, p, n, id, r from given
    union all
    select k + 1, step.w, step.p,
           case when step.p = found.hit then found.n2 else step.n end,
           case when step.p = found.hit then found.merged else step.id end,
           case when step.p = found.hit then found.r2 when step.n = found.hit then found.merged else step.r end
    from step join (
        select best.w, best.hit, best.merged, best.gone, after.n as n2, after.r as r2
        from (
            select w, min((merged::bigint << 32) | p) & 4294967295 as hit,
                   min((merged::bigint << 32) | p) >> 32 as merged,
                   arg_min(n, (merged::bigint << 32) | p) as gone
            from step join merges on pair = (id::bigint << 20) | r
            group by w
        ) best
        join step after on after.w = best.w and after.p = best.gone
    ) found on step.w = found.w
    where step.p <> found.gone
)
select step.w, step.p, step.id from step
join (select w, max(k) as k from step group by w) last on step.w = last.w and step.k = last.k
"""
CONTRACT_LONG = """
with recursive step(k, w, p, n, id, r) as (
    select 0, w, p, n, id, r from given
    union all
    (
        with pairs as (
            select w, p, n, merged, alone from (select * from step where k < {most}) join merges_here on pair = (id::bigint << 20) | r
        ),
        hits as (
            select w, p, n, merged, alone, row_number() over (partition by w order by p) as place,
                   lag(n, 1, -2) over (partition by w order by p) = p as joined
            from pairs join (select w, min(merged) as merged from pairs group by w) using (w, merged)
        ),
        runs as (
            select *, max(case when joined then 0 else place end) over (partition by w order by p rows unbounded preceding) as head from hits
        ),
        taken as (
            select w, p, n, merged from runs where case when alone then place = 1 else (place - head) % 2 = 0 end
        ),
        left_over as (
            select k, step.w, step.p, coalesce(after.n, step.n) as n, coalesce(taken.merged, step.id) as id, coalesce(after.r, step.r) as r
            from step
            semi join taken as any_taken on any_taken.w = step.w
            anti join taken as before on before.w = step.w and before.n = step.p
            left join taken on taken.w = step.w and taken.p = step.p
            left join (select step.w, step.p, step.n, step.r from step join taken on taken.w = step.w and taken.n = step.p) after
            on after.w = taken.w and after.p = taken.n
        )
        select k + 1, left_over.w, left_over.p, left_over.n, id, coalesce(taken.merged, r)
        from left_over left join taken on taken.w = left_over.w and taken.p = left_over.n
    )
)
select step.w, step.p, step.n, step.id, step.r, step.k from step
join (select w, max(k) as k from step group by w) last on step.w = last.w and step.k = last.k
"""


def read_ranks(path: str) -> dict[bytes, int]:
    """The ranks of a vocabulary file: a token in base 64 and its rank on each line."""
    with open(path, "rb") as f:
        return {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in f if line.strip())}


def _joined(known: dict, keys: list) -> bytes:
    """The values of the keys in a row."""
    return b"".join(itemgetter(*keys)(known)) if len(keys) > 1 else b"".join([known[x] for x in keys])


def _contracted_alone(ranks: dict[bytes, int]) -> set[int]:
    """Tokens that may, once made from the least pair of a word, form a pair of a smaller rank.

    x y becomes t while z follows; t z has a smaller rank than t. If y z has one too, it would have been
    contracted before, so t counts only where y z has none. The same holds with z before.
    """
    found = set()
    for whole, rank in ranks.items():
        for i in range(1, len(whole)):
            for t, z, ahead in ((whole[:i], whole[i:], False), (whole[i:], whole[:i], True)):
                made = ranks.get(t, -1)
                if made < rank or z not in ranks or made in found:
                    continue
                for j in range(1, len(t)):
                    if t[:j] in ranks and t[j:] in ranks and ranks.get(z + t[:j] if ahead else t[j:] + z, made) >= made:
                        found.add(made)
    return found


def _parts(words: set[bytes]) -> Iterator[list[bytes]]:
    """The words in lists of bounded number and sum of squared lengths, as a word leaves about half its square in rows."""
    part, size = [], 0
    for word in words:
        if part and (len(part) == WORDS_A_QUERY or size + len(word) ** 2 > SQUARES_A_QUERY):
            yield part
            part, size = [], 0
        part.append(word)
        size += len(word) ** 2
    if part:
        yield part


class Codec:
    """Encodes and decodes inside one worker."""

    def __init__(self, ranks: dict[bytes, int], pattern: str, memory: int = MEMORY, characters: int = CHARACTERS_A_ROUND) -> None:
        merges = [
            (ranks[t[:i]] << 20 | ranks[t[i:]], rank)
            for t, rank in ranks.items()
            for i in range(1, len(t))
            if t[:i] in ranks and t[i:] in ranks
        ]
        self.con = duckdb.connect()
        self.con.execute("set threads = 1; set memory_limit = '250MB'")
        pair, merged = (np.array(x, np.int64) for x in zip(*merges)) if merges else (np.zeros(0, np.int64),) * 2
        apart = _contracted_alone(ranks)
        alone = np.fromiter((m in apart for m in merged.tolist()), bool, len(merged))
        self.con.register("given", pa.table({"pair": pair, "merged": merged, "alone": alone}))
        self.con.execute("create table merges as select pair, merged, alone from given")
        self.byte_ids = np.array([ranks[bytes([b])] for b in range(256)], np.int64)
        self.texts = [b""] * (max(ranks.values()) + 1)
        for t, r in ranks.items():
            self.texts[r] = t
        self.vocabulary = pa.array(self.texts, pa.large_binary())
        self.names = [str(i) for i in range(len(self.texts))]
        self.pattern = regex.compile(pattern)
        self.pieces = Memory()
        self.memory, self.round = memory, characters

    def _positions(self, words: list[bytes]) -> tuple[np.ndarray, ...]:
        """Word, position, next position, token and next token of each byte; the last one's next are -1."""
        length = np.fromiter(map(len, words), np.int64, len(words))
        ends = np.cumsum(length)
        n = int(ends[-1])
        w = np.repeat(np.arange(len(words)), length)
        p = np.arange(n) - np.repeat(ends - length, length)
        ids = self.byte_ids[np.frombuffer(b"".join(words), np.uint8)]
        after, right = np.append(p[1:], -1), np.append(ids[1:], -1)
        after[ends - 1] = right[ends - 1] = -1
        return w, p, after, ids, right

    def _contract_long(self, words: list[bytes]) -> list[bytes]:
        """The ids of each word, four bytes each, for words of any length."""
        w, p, n, ids, r = self._positions(words)
        text = b"\n".join(words)
        here = [i for i, t in enumerate(self.texts) if t in text]
        self.con.register("given", pa.table({"merged": here}))
        self.con.execute("create or replace temp table merges_here as select merges.* from merges semi join given using (merged)")
        done = [b""] * len(words)
        while len(w):
            most = max(1, ROWS_OF_LONG // len(w))
            self.con.register("given", pa.table({"w": w, "p": p, "n": n, "id": ids, "r": r}))
            got = self.con.sql(CONTRACT_LONG.format(most=most)).to_arrow_table()
            columns = [got.column(c).to_numpy() for c in ("w", "p", "n", "id", "r", "k")]
            order = np.lexsort((columns[1], columns[0]))
            w, p, n, ids, r, k = (c[order] for c in columns)
            at, first = np.unique(w, return_index=True)
            for i, a, z in zip(at.tolist(), first.tolist(), [*first[1:].tolist(), len(w)]):
                if k[a] < most:
                    done[i] = ids[a:z].astype("<i4").tobytes()
            more = k == most
            w, p, n, ids, r = (c[more] for c in (w, p, n, ids, r))
        return done

    def _contract(self, words: list[bytes]) -> list[bytes]:
        """The ids of each word, four bytes each, for words of at most ``LONG`` bytes."""
        w, p, n, ids, r = self._positions(words)
        self.con.register("given", pa.table({"w": w, "p": p, "n": n, "id": ids, "r": r}))
        got = self.con.sql(CONTRACT).to_arrow_table()
        w, p, ids = (got.column(c).to_numpy() for c in ("w", "p", "id"))
        order = np.lexsort((p, w))
        flat = ids[order].astype("<i4").tobytes()
        ends = (4 * np.cumsum(np.bincount(w, minlength=len(words)))).tolist()
        return [flat[a:b] for a, b in zip([0, *ends], ends)]

    def _learn(self, pieces: set[str]) -> None:
        matches = {x: self.pattern.findall(x) for x in pieces}
        # A match that is remembered as a piece of its own is not contracted again.
        ids: dict[str, bytes] = {m: self.pieces[m] for ms in matches.values() for m in ms if m in self.pieces and not m[-1].isspace()}
        raw = {m.encode("utf-8", "surrogatepass"): m for ms in matches.values() for m in ms if m not in ids}
        words, long = raw.keys(), {m for m in raw if len(m) > LONG}
        for some, contract in ((words - long, self._contract), (long, self._contract_long)):
            for part in _parts(some):
                ids.update(zip([raw[m] for m in part], contract(part)))
        for x, ms in matches.items():
            self.pieces[x] = b"".join([ids[m] for m in ms])

    def encode(self, texts: list[str]) -> Iterator[np.ndarray]:
        """The ids of each text; an empty text has none."""
        at = 0
        while at < len(texts):
            cuts, size = [], 0
            while at < len(texts) and (size < self.round or not cuts):
                cuts.append(cut(texts[at]))
                size += len(texts[at])
                at += 1
            met = set().union(*cuts)
            new = self.pieces.room_for(met, self.memory)
            if new:
                self._learn(new)
            for c in cuts:
                yield np.frombuffer(_joined(self.pieces, c), "<i4")

    def decode(self, many: list[np.ndarray]) -> Iterator[bytes]:
        """The bytes of each sequence of ids: the vocabulary's rows, taken in the order of the ids and joined."""
        at = 0
        while at < len(many):
            begin, size = at, 0
            while at < len(many) and (size < self.round or at == begin):
                size += 4 * len(many[at])
                at += 1
            part = many[begin:at]
            taken = self.vocabulary.take(pa.array(np.concatenate(part), pa.int32()))
            data, ends = taken.buffers()[2], np.frombuffer(taken.buffers()[1], np.int64)[taken.offset :]
            ends = ends[np.cumsum([0, *map(len, part)])].tolist()
            for a, z in zip(ends, ends[1:]):
                yield data[a:z].to_pybytes() if z > a else b""


def _codec(held, pattern: str, path: str, memory: int = MEMORY, characters: int = CHARACTERS_A_ROUND) -> Codec:  # noqa: ANN001
    cache = worker_cache("bpe")
    key = (path, pattern, memory, characters)
    if key not in cache:
        cache.clear()
        cache[key] = Codec(held.value, pattern, memory, characters)
    return cache[key]


def _texts(column: pa.Array) -> list[str]:
    return [x or "" for x in column.to_pylist()]


def encode(docs: DataFrame, path: str, pattern: str, text_col: str = "text") -> DataFrame:
    """All columns of ``docs`` and ``ids``, the token ids of the text (null: none)."""
    held = docs.sparkSession.sparkContext.broadcast(read_ranks(path))
    docs = docs.drop("ids")
    names, schema = docs.columns, ", ".join(f"`{n}` {t}" for n, t in docs.dtypes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = _codec(held, pattern, path)
        for b in batches:
            ids = list(codec.encode(_texts(b.column(names.index(text_col)))))
            offsets = np.concatenate([[0], np.cumsum([len(x) for x in ids])]).astype(np.int32)
            flat = np.concatenate(ids) if ids else np.zeros(0, np.int32)
            column = pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat, pa.int32()))
            yield pa.RecordBatch.from_arrays([*b.columns, column], [*names, "ids"])

    return docs.mapInArrow(run, schema + ", ids array<int>")


def decode(encoded: DataFrame, path: str, pattern: str, ids_col: str = "ids") -> DataFrame:
    """All columns and ``bytes``, what the ids stand for (null: empty)."""
    held = encoded.sparkSession.sparkContext.broadcast(read_ranks(path))
    encoded = encoded.drop("bytes")
    names, schema = encoded.columns, ", ".join(f"`{n}` {t}" for n, t in encoded.dtypes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = _codec(held, pattern, path)
        for b in batches:
            ids = [np.array(x.as_py() or [], np.int32) for x in b.column(names.index(ids_col))]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(list(codec.decode(ids)), pa.binary())], [*names, "bytes"])

    return encoded.mapInArrow(run, schema + ", bytes binary")


def digests(
    docs: DataFrame, path: str, pattern: str, with_ids: bool = False, memory: int = MEMORY, characters: int = CHARACTERS_A_ROUND
) -> DataFrame:
    """doc_id, n_tokens, ids_sha256 and decoded_sha256 (and the ids) of each row: encoded and decoded in one pass.

    ``memory`` bounds what a worker remembers, ``characters`` what it takes at a time; only speed depends on them.
    Null and empty texts have no ids; repeated rows and null ids pass through; other columns are left out.
    """
    held = docs.sparkSession.sparkContext.broadcast(read_ranks(path))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = _codec(held, pattern, path, memory, characters)
        for b in batches:
            texts, rows, at = _texts(b.column("text")), [], 0
            while at < len(texts):
                part, size = [], 0
                while at < len(texts) and (size < codec.round or not part):
                    part.append(texts[at])
                    size += len(texts[at])
                    at += 1
                ids = list(codec.encode(part))
                for x, back in zip(ids, codec.decode(ids)):
                    said = " ".join([codec.names[i] for i in x.tolist()]).encode()
                    row = (len(x), hashlib.sha256(said).hexdigest(), hashlib.sha256(back).hexdigest())
                    rows.append((*row, x) if with_ids else row)
            columns = zip(*rows) if rows else [()] * len(kinds)
            arrays = [pa.array(c, t) for c, (_, t) in zip(columns, kinds)]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), *arrays], ["doc_id", *[k for k, _ in kinds]])

    kinds = [("n_tokens", pa.int64()), ("ids_sha256", pa.string()), ("decoded_sha256", pa.string())]
    schema = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"
    if with_ids:
        kinds, schema = [*kinds, ("ids", pa.list_(pa.int32()))], schema + ", ids array<int>"
    return docs.selectExpr("cast(doc_id as long) as doc_id", "text").mapInArrow(run, schema)
