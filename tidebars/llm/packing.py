"""Best-fit packing of documents into sequences by bin-completion branch-and-bound.

Documents are cut into pieces of at most a sequence's tokens (only longer ones; the first piece takes the
remainder). Pieces are dealt by hash into groups of bounded size. In each group the largest piece left
opens a sequence, and the sequence is completed by a filling of least waste, which sums reachable as bits of
a number give without search; best-fit decreasing is the other incumbent. Where neither meets the bound
(total length, and pieces of over half a sequence), branch-and-bound goes over the last SEARCH_SEQUENCES
sequences: fillings around the largest piece in order of waste, without those that another one dominates (an
open piece fits in place of a smaller one, or of two that are no longer), until the waste so far leaves
no way to save a sequence. A group of so few sequences is searched as a whole, and the result is then
the best there is unless the search ends after NODES fillings; where it does, or in the first sequences of
a larger group, the incumbent stands. `fill` with nodes=None searches without end.

Ids are those of the tokenizer file, marks such as an end of text that a text spells out included.

Defined results: a null text counts as empty (one piece with the end mark alone); repeated rows are packed
each; an empty table gives an empty one; columns named like a result give way to it in `pack`.
"""

from __future__ import annotations

import base64
import bisect
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidebars.llm.common import in_blocks, materialize

#: Pieces in a group.
GROUP_PIECES = 16384
#: Sequences of a group, those filled last, that are searched together.
SEARCH_SEQUENCES = 32
#: Fillings that the search of a group looks at.
NODES = 4000
END_ID = 0

_encoders: dict[str, object] = {}


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def _encoder(path: str):
    """The ids of the tokenizer file at path as a function of a text, loaded once in a process.

    Where the same vocabulary lies beside it as ranks, the faster library with equal ids reads those;
    texts that spell out one of the file's added tokens, or that library can't take (very long runs of one
    kind of character), go to the first one.
    """
    if path not in _encoders:
        from tokenizers import Tokenizer

        slow = Tokenizer.from_file(path)
        marks = tuple(t.content for t in slow.get_added_tokens_decoder().values())

        def plain(text: str) -> np.ndarray:
            return np.array(slow.encode(text, add_special_tokens=False).ids, dtype="<u4")

        found = plain
        ranks = path.removesuffix(".json") + ".tiktoken"
        try:
            with open(ranks, "rb") as file:
                pairs = {base64.b64decode(a): int(b) for a, b in map(bytes.split, file)}
        except FileNotFoundError:
            pairs = None
        if pairs is not None:
            import public_tokenizers
            import tiktoken

            fast = tiktoken.Encoding("pieces", pat_str=public_tokenizers.PATTERN, mergeable_ranks=pairs, special_tokens={})

            def found(text: str) -> np.ndarray:
                if any(m in text for m in marks):
                    return plain(text)
                try:
                    return np.array(fast.encode_ordinary(text), dtype="<u4")
                except BaseException as error:  # the library's panics aren't Exceptions
                    if isinstance(error, (KeyboardInterrupt, SystemExit, MemoryError)):
                        raise
                    return plain(text)

        _encoders[path] = found
    return _encoders[path]


def cut(n: int, most: int) -> list[tuple[int, int]]:
    """(start, length) of the pieces of n tokens: whole if it fits, else the remainder first."""
    if n <= most:
        return [(0, n)]
    first = n % most
    return ([(0, first)] if first else []) + [(s, most) for s in range(first, n, most)]


def tokenize(docs: DataFrame, most: int, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = False) -> DataFrame:
    """A row for each piece: id, piece, start, length, ids_crc32 and, if asked for, its ids."""
    id_type = docs.schema[id_col].dataType.simpleString()
    schema = f"`{id_col}` {id_type}, piece int, start long, length long, ids_crc32 long" + ", ids array<int>" * with_ids

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = _encoder(tokenizer)
        for batch in batches:
            keys, texts = batch.column(0), batch.column(1).to_pylist()
            for a, b in in_blocks(texts):
                at, rows, parts = [], [], []
                for i in range(a, b):
                    ids = np.append(encode(texts[i] or ""), np.array([END_ID], "<u4"))
                    for k, (start, length) in enumerate(cut(len(ids), most)):
                        own = ids[start : start + length]
                        at.append(i)
                        rows.append((k, start, length, zlib.crc32(own.tobytes())))
                        if with_ids:
                            parts.append(own.astype(np.int32))
                piece, start, length, crc = zip(*rows)
                columns = [keys.take(pa.array(at)), pa.array(piece, pa.int32()), *(pa.array(x, pa.int64()) for x in (start, length, crc))]
                if with_ids:
                    columns.append(pa.array(parts, pa.list_(pa.int32())))
                yield pa.RecordBatch.from_arrays(columns, [id_col, "piece", "start", "length", "ids_crc32"] + ["ids"] * with_ids)

    return docs.select(id_col, text_col).mapInArrow(run, schema)


class Pieces:
    """How many pieces of each length are left."""

    def __init__(self, lengths: np.ndarray, most: int):
        self.counts = np.bincount(lengths, minlength=most + 1).tolist()
        self.have = sum(1 << n for n, c in enumerate(self.counts) if c)  # bit n: any of length n

    def take(self, filling: list[int]) -> None:
        for n in filling:
            self.counts[n] -= 1
            if not self.counts[n]:
                self.have ^= 1 << n

    def put(self, filling: list[int]) -> None:
        for n in filling:
            self.counts[n] += 1
            self.have |= 1 << n

    def lengths(self, room: int) -> list[int]:
        """Those up to room, ascending."""
        bits, out = bin(self.have & ((1 << room + 1) - 1))[:1:-1], []
        at = bits.find("1")
        while at >= 0:
            out.append(at)
            at = bits.find("1", at + 1)
        return out

    def fillings(self, room: int, most_waste: int) -> Iterator[list[int]]:
        """Sets of pieces for room in order of waste, larger pieces first in each."""
        own, reach, full = self.lengths(room), [1], (1 << room + 1) - 1
        for n in own:  # the sums that pieces up to this length reach, with n taken 1, 2, 4, ... times
            sums, left, step = reach[-1], min(self.counts[n], room // n), 1
            while left > 0:
                sums |= sums << n * min(step, left) & full
                left, step = left - step, 2 * step
            reach.append(sums)

        def walk(k: int, target: int) -> Iterator[list[int]]:
            if not target:
                yield []
                return
            for j in range(min(k, bisect.bisect_right(own, target)), 0, -1):
                n = own[j - 1]
                for times in range(min(self.counts[n], target // n), 0, -1):
                    if reach[j - 1] >> target - times * n & 1:
                        for rest in walk(j - 1, target - times * n):
                            yield [n] * times + rest
                if not reach[j - 1] >> target & 1:
                    return

        for waste in range(min(most_waste, room) + 1):
            if reach[-1] >> room - waste & 1:
                yield from walk(len(own), room - waste)

    def dominated(self, filling: list[int], waste: int) -> bool:
        """Whether a piece that is left fits in place of a smaller one of the filling, or of two that are no longer."""
        kinds = sorted(set(filling))
        if any(self.have >> n + 1 & (1 << waste) - 1 for n in kinds):
            return True
        pairs = [n + m for k, n in enumerate(kinds) for m in kinds[k + 1 :]] + [2 * n for n in kinds if filling.count(n) > 1]
        return any(self.have >> n & (1 << waste + 1) - 1 for n in pairs)


def least_sequences(lengths: np.ndarray, most: int) -> int:
    """No packing has fewer: by total length, and by pieces of over half a sequence and those that fit beside none of them."""
    bounds = [-(-int(lengths.sum()) // most)]
    for small in [0, *np.unique(lengths[2 * lengths <= most]).tolist()]:
        large, half = lengths[lengths > most - small], lengths[(lengths <= most - small) & (2 * lengths > most)]
        rest = int(lengths[(2 * lengths <= most) & (lengths >= small)].sum()) - int((most - half).sum())
        bounds.append(len(large) + len(half) + max(0, -(-rest // most)))
    return max(bounds)


def _best_fit(lengths: np.ndarray, most: int) -> list[list[int]]:
    """Largest first, each into the fullest sequence that has room."""
    out: list[list[int]] = []
    open_: list[list[int]] = [[] for _ in range(most + 1)]  # sequences by room
    rooms = 0
    for n in sorted(lengths.tolist(), reverse=True):
        fits = rooms >> n
        room = n + (fits & -fits).bit_length() - 1 if fits else most
        if fits:
            k = open_[room].pop()
            if not open_[room]:
                rooms ^= 1 << room
        else:
            k = len(out)
            out.append([])
        out[k].append(n)
        open_[room - n].append(k)
        rooms |= 1 << room - n
    return out


def _least_waste(lengths: np.ndarray, most: int) -> list[list[int]]:
    """The largest piece left, completed by the first filling of least waste."""
    pieces, out = Pieces(lengths, most), []
    while pieces.have:
        own = [pieces.have.bit_length() - 1]
        pieces.take(own)
        rest = next(pieces.fillings(most - own[0], most))
        pieces.take(rest)
        out.append(own + rest)
    return out


def _search(lengths: np.ndarray, most: int, known: int, nodes: int | None) -> list[list[int]] | None:
    """Fewer than `known` sequences, as few as there can be, by branch-and-bound; None if none are found within `nodes` fillings."""
    pieces, total, least = Pieces(lengths, most), int(lengths.sum()), least_sequences(lengths, most)
    best, taken, spare = None, [], [(known - 1) * most - total]  # spare: waste that still saves a sequence

    def level() -> Iterator[list[int]]:
        own = [pieces.have.bit_length() - 1]
        pieces.take(own)
        for rest in pieces.fillings(most - own[0], min(most, spare[0])):
            waste = most - own[0] - sum(rest)
            if waste > spare[0]:
                break
            pieces.take(rest)
            worse = pieces.dominated(rest, waste)
            pieces.put(rest)
            yield [] if worse else own + rest
        pieces.put(own)

    if spare[0] < 0:
        return None
    stack = [level()]
    left = float("inf") if nodes is None else nodes
    while stack and left > 0:
        if len(taken) == len(stack):  # back from below: what was taken here is put back
            done = taken.pop()
            pieces.put(done[1:])
            spare[0] += most - sum(done)
        filling = next(stack[-1], None)
        left -= 1
        if filling is None:
            stack.pop()
        elif filling:
            pieces.take(filling[1:])
            taken.append(filling)
            spare[0] -= most - sum(filling)
            if pieces.have:
                stack.append(level())
            else:
                best = [f.copy() for f in taken]
                if len(best) == least:
                    break
                spare[0] -= (known - len(best)) * most
                known = len(best)
                while stack and spare[0] < 0:  # go back to where a sequence can still be saved
                    done = taken.pop()
                    pieces.put(done[1:])
                    spare[0] += most - sum(done)
                    if spare[0] < 0:
                        stack.pop().close()
                        pieces.put(done[:1])
    return best


def fill(lengths: np.ndarray, most: int, nodes: int | None = NODES) -> tuple[np.ndarray, np.ndarray]:
    """The sequence and the offset of each piece of one group."""
    lengths = np.asarray(lengths, np.int64)
    found = min(_least_waste(lengths, most), _best_fit(lengths, most), key=len) if len(lengths) else []
    if len(found) > least_sequences(lengths, most) and nodes != 0:
        found.sort(key=lambda f: (sum(f) < most, -sum(f)))
        fixed = found[:-SEARCH_SEQUENCES] if nodes is not None else []
        rest = found[len(fixed) :]
        better = _search(np.array([n for f in rest for n in f], np.int64), most, len(rest), nodes)
        found = fixed + (better or rest)
    order = np.argsort(lengths, kind="stable")
    ends = np.cumsum(np.bincount(lengths, minlength=most + 1))  # pieces of length n are order[ends[n - 1]:ends[n]], taken from the back
    sequence, offset = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64)
    for number, filling in enumerate(found):
        at = 0
        for n in filling:
            ends[n] -= 1
            sequence[order[ends[n]]], offset[order[ends[n]]] = number, at
            at += n
    return sequence, offset


def pack(pieces: DataFrame, most: int, length_col: str = "length", nodes: int | None = NODES, group_pieces: int | None = GROUP_PIECES) -> DataFrame:
    """pieces with sequence_id and offset. Only these columns are shuffled, so leave ids out and join them later.

    nodes: fillings that the search of a group looks at; None searches all its sequences to the end, which gives the fewest
    there can be. group_pieces: pieces of a group; None packs all in one task.
    """
    pieces = materialize(pieces.drop("sequence_id", "offset"), "pieces")
    groups = max(1, -(-pieces.count() // group_pieces)) if group_pieces else 1
    by = [F.col(c) for c, kind in pieces.dtypes if not kind.startswith(("map", "array", "struct"))]
    schema = ", ".join(f"`{c}` {kind}" for c, kind in pieces.dtypes) + ", sequence_id long, offset long"

    def run(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.drop(columns="__group")
        sequence, offset = fill(rows[length_col].to_numpy(np.int64), most, nodes)
        return rows.assign(sequence_id=sequence + (int(key[0]) << 32), offset=offset)

    dealt = pieces.withColumn("__group", F.pmod(F.xxhash64(*by), F.lit(groups)))
    return dealt.groupBy("__group").applyInPandas(run, schema)


def pack_documents(docs: DataFrame, most: int = 2048, tokenizer: str | None = None, id_col: str = "doc_id", text_col: str = "text", nodes: int | None = NODES, group_pieces: int | None = GROUP_PIECES) -> DataFrame:
    """Per piece: id, piece, start, length, ids_crc32, sequence_id, offset; nodes and group_pieces as in `pack`."""
    return pack(tokenize(docs, most, tokenizer or default_tokenizer(), id_col, text_col), most, "length", nodes, group_pieces)


def sequences(docs: DataFrame, most: int = 2048, tokenizer: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The packed sequences themselves: sequence_id, ids. The ids of a piece meet its place by id and piece."""
    tokenizer = tokenizer or default_tokenizer()
    places = pack(tokenize(docs, most, tokenizer, id_col, text_col), most)
    ids = tokenize(docs, most, tokenizer, id_col, text_col, with_ids=True).select(id_col, "piece", "ids_crc32", "ids").dropDuplicates([id_col, "piece", "ids_crc32"])
    joined = places.join(ids, [id_col, "piece", "ids_crc32"])
    parts = F.array_sort(F.collect_list(F.struct("offset", "ids")))
    return joined.groupBy("sequence_id").agg(F.flatten(F.transform(parts, lambda p: p["ids"])).alias("ids"))
