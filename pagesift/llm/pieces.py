"""SentencePiece BPE ids by a prefix table, and texts from ids.

For each prefix of a text there is one token only that ends the encoding of that prefix. So no
merges are replayed: an automaton gives the pieces that end at each place, the one that
is compatible with the last token of the prefix before it is stored, and the ids are read from the
table backwards. A piece follows another one if the two, encoded together, stay the two.
"""

from __future__ import annotations

from bisect import bisect
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.types import StringType, StructField, StructType

from .rows import slices, worker_store
from .wordtable import WordTable, by_text, joined

KEPT_PAIRS = 1 << 20
NEVER = 1 << 60
ENCODED = "doc_id long, n_tokens long, ids binary"


class MergeTable:
    """The last token of each prefix, for pieces that merge by score, the leftmost of equal ones first.

    Any two neighbours merge if their concatenation is a piece, the one with the highest score first. Characters that are
    no piece are tokens of their own.
    """

    def __init__(self, scores: dict[str, float]):
        import ahocorasick

        order = sorted(set(scores.values()), reverse=True)
        place = {score: i for i, score in enumerate(order)}
        self.rank = {piece: place[score] for piece, score in scores.items()}
        self.pieces = ahocorasick.Automaton()
        for piece in scores:
            self.pieces.add_word(piece, piece)
        self.pieces.make_automaton()
        self.seams: dict[str, tuple | None] = {}
        self.fits: dict[tuple[str, str], bool] = {}

    def merged(self, text: str) -> tuple[list[str], list[tuple[str, str]]]:
        """Symbols that are left when nothing merges any more, and the pairs that merged, in order."""
        symbols, history = list(text), []
        while True:
            ranks = [self.rank.get(a + b, NEVER) for a, b in zip(symbols, symbols[1:])]
            low = min(ranks, default=NEVER)
            if low == NEVER:
                return symbols, history
            at = ranks.index(low)
            history.append((symbols[at], symbols[at + 1]))
            symbols[at : at + 2] = ["".join(symbols[at : at + 2])]

    def seam(self, piece: str) -> tuple[list, list, bool] | None:
        """How a piece came about: the symbols at its left and right edge, the last first, each with the rank that made it.

        The flag tells whether ranks rise from part to whole, so that they order the merges in time. None
        if the piece does not merge to itself: then no encoding holds it.
        """
        if piece not in self.seams:
            self.seams[piece] = self._seam(piece)
        return self.seams[piece]

    def _seam(self, piece: str) -> tuple[list, list, bool] | None:
        if len(piece) == 1:
            return [(piece, -1)], [(piece, -1)], True
        symbols, history = self.merged(piece)
        if len(symbols) > 1:
            return None
        a, b = history[-1]
        (left, _, plain_a), (_, right, plain_b) = self.seam(a), self.seam(b)
        made = self.rank[piece]
        rises = plain_a and plain_b and max(left[0][1], right[0][1]) < made
        return [(piece, made), *left], [(piece, made), *right], rises

    def compatible(self, a: str, b: str) -> bool:
        """Does the text a + b encode to the two tokens a and b?"""
        key = (a, b)
        found = self.fits.get(key)
        if found is None:
            if len(self.fits) >= KEPT_PAIRS:
                self.fits.clear()
            found = self.fits[key] = self._compatible(a, b)
        return found

    def _compatible(self, a: str, b: str) -> bool:
        before, after = self.seam(a), self.seam(b)
        if before is None or after is None:
            return False
        if not (before[2] and after[2]):
            return self.merged(a + b)[0] == [a, b]
        # Back in time: undo the later of the two edges' merges, and see that the pair across never was due.
        right, left = before[1], after[0]
        i = j = 0
        ends_a = ends_b = NEVER  # when the two symbols at the seam were merged away
        while True:
            due = self.rank.get(right[i][0] + left[j][0], NEVER)
            if due < ends_a and due <= ends_b and due != NEVER:
                return False
            made_a, made_b = right[i][1], left[j][1]
            if made_a < 0 and made_b < 0:
                return True
            if made_a > made_b:
                i, ends_a = i + 1, made_a
            else:
                j, ends_b = j + 1, made_b

    def last_tokens(self, text: str) -> list[str | None]:
        """The token that ends the encoding of ``text[:i]``, for each i."""
        last: list[str | None] = [None] * (len(text) + 1)
        done, fits = 0, self.fits.get
        for end, piece in self.pieces.iter(text):
            end += 1
            while done < end - 1:  # no piece ends here
                done += 1
                if last[done] is None:
                    last[done] = text[done - 1]
            if last[end] is not None:
                continue
            start = end - len(piece)
            if start == 0:
                if self.seam(piece) is not None:
                    last[end] = piece
            else:
                before = last[start]
                ok = fits((before, piece))
                if ok or ok is None and self.compatible(before, piece):
                    last[end] = piece
        for i in range(done + 1, len(text) + 1):
            if last[i] is None:
                last[i] = text[i - 1]
        return last

    def tokens(self, text: str) -> list[str]:
        """The encoding, read from the table backwards."""
        last, at, out = self.last_tokens(text), len(text), []
        while at:
            out.append(last[at])
            at -= len(last[at])
        return out[::-1]


class PieceCodec:
    """Ids and texts by a BPE model file of the ``sentencepiece`` library, which normalises and decodes.

    Where no piece goes on over the start of a run of blanks, no merge does either, so a
    text is encoded by units of blanks and the word behind them, each distinct one once (:mod:`wordtable`). Characters of one
    byte that stand in no piece are units too.
    """

    def __init__(self, path: str):
        import sentencepiece
        from sentencepiece import sentencepiece_model_pb2

        spec = sentencepiece_model_pb2.ModelProto()
        with open(path, "rb") as file:
            spec.ParseFromString(file.read())
        kinds = spec.SentencePiece
        if spec.trainer_spec.model_type != spec.trainer_spec.BPE or any(p.type in (kinds.USER_DEFINED, kinds.UNUSED) for p in spec.pieces):
            raise ValueError(f"{path} is no plain BPE model")
        self.model = sentencepiece.SentencePieceProcessor(model_file=path)
        self.id_of = {p.piece: i for i, p in enumerate(spec.pieces) if p.type == kinds.NORMAL}
        self.table = MergeTable({p: spec.pieces[i].score for p, i in self.id_of.items()})
        self.byte_ids = [self.model.piece_to_id(f"<0x{b:02X}>") for b in range(256)] if spec.trainer_spec.byte_fallback else None
        self.unknown = self.model.unk_id()
        self.begin, self.end = self.model.bos_id(), self.model.eos_id()
        self.mark = "▁"
        self.by_unit = not any(self.mark in p.lstrip(self.mark) or " " in p for p in self.id_of)
        self.by_unit = self.by_unit and spec.normalizer_spec.escape_whitespaces
        inside = set("".join(self.id_of))
        self.alone = np.array([b < 0x80 and chr(b) not in inside and b != 0x20 for b in range(256)])
        self.units = WordTable(self._units)

    def ids(self, text: str) -> list[int]:
        """Ids of a normalised text."""
        out, unknown_before = [], False
        for token in self.table.tokens(text):
            i = self.id_of.get(token)
            if i is not None:
                out.append(i)
            elif self.byte_ids:
                out += [self.byte_ids[b] for b in token.encode()]
            elif not unknown_before:  # a run of unknown characters is one token
                out.append(self.unknown)
            unknown_before = i is None
        return out

    def _units(self, units: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        found = [self.ids(u.decode().replace(" ", self.mark)) for u in units]
        counts = np.array([len(ids) for ids in found], dtype=np.int64)
        return np.fromiter(chain.from_iterable(found), np.uint32, int(counts.sum())), counts

    def encode(self, texts: list[str], begin: bool = True, end: bool = True) -> list[bytes]:
        """Little-endian unsigned 32-bit ids of each text."""
        plain = [self.model.normalize(t) for t in texts]
        if self.by_unit and self.byte_ids:
            found = self._by_unit([t.replace(self.mark, " ").encode() for t in plain])
        else:
            found = [np.array(self.ids(t), dtype="<u4").tobytes() for t in plain]
        first = np.array([self.begin] if begin else [], dtype="<u4").tobytes()
        last = np.array([self.end] if end else [], dtype="<u4").tobytes()
        return [first + ids + last for ids in found]

    def _by_unit(self, texts: list[bytes]) -> list[bytes]:
        data, bounds = joined(texts)
        size = int(bounds[-1])
        text = data[:size]
        blank, alone = text == 0x20, self.alone[text]
        start = alone.copy()
        start[1:] |= (blank[1:] & ~blank[:-1]) | alone[:-1]
        start[bounds[:-1]] = True
        start[bounds[1:] - 1] = True  # the byte behind a text
        starts = np.flatnonzero(start)
        sizes = np.diff(starts, append=size)
        real = np.ones(size, dtype=bool)
        real[bounds[1:] - 1] = False
        real = real[starts]
        starts, sizes = starts[real], sizes[real]
        ids, counts = self.units.ids(data, starts, sizes)
        return by_text(ids, counts, starts, bounds)

    def decode(self, ids: list[bytes]) -> list[str]:
        return self.model.decode([np.frombuffer(i, "<u4").tolist() for i in ids], num_threads=1) if ids else []


def codec(path: str) -> PieceCodec:
    """The worker's codec of a model file."""
    store = worker_store("pieces")
    if path not in store:
        store[path] = PieceCodec(path)
    return store[path]


def _encode(path: str, begin: bool, end: bool):
    def run(batches):
        for part, texts in slices(batches, "text"):
            ids = codec(path).encode(texts, begin, end)
            counts = pa.array([len(i) // 4 for i in ids], pa.int64())
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), counts, pa.array(ids, pa.binary())], names=["doc_id", "n_tokens", "ids"])

    return run


def encode_pieces(
    docs: DataFrame, model: str, begin: bool = True, end: bool = True, doc_id: str = "doc_id", text: str = "text",
) -> DataFrame:
    """``doc_id, n_tokens, ids`` of every row: the ids that the library gives for the whole text, as little-endian
    unsigned 32-bit numbers, with the begin and end ids counted.

    A null text is empty: its ids are the begin and end ids alone. Repeated rows and null ids are
    rows of their own, and no order or tie matters. Very long texts are encoded whole, in time that grows with their length. Other columns are not
    looked at, whatever their names. No rows give no rows. Nothing is shuffled.
    """
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    return rows.mapInArrow(_encode(model, begin, end), ENCODED)


def _decode(path: str, place: int):
    def run(batches):
        for batch in batches:
            held, at = batch.column(place).to_pylist(), 0
            edges = np.cumsum([len(i or b"") for i in held]).tolist()
            while at < len(held):  # some megabytes of ids at a time
                end = max(at + 1, bisect(edges, (edges[at - 1] if at else 0) + (4 << 20), lo=at))
                real = [i for i in held[at:end] if i is not None]
                texts = iter(codec(path).decode(real))
                found = pa.array([None if i is None else next(texts) for i in held[at:end]], pa.string())
                part = batch.slice(at, end - at)
                yield pa.RecordBatch.from_arrays([*part.columns, found], names=[*map(str, range(part.num_columns + 1))])
                at = end

    return run


def decode_pieces(rows: DataFrame, model: str, ids: str = "ids", out: str = "decoded") -> DataFrame:
    """The columns of ``rows`` and ``out``, the text that the library decodes from the column ``ids``.

    Null ids give a null text, no ids an empty one. A column that is already named ``out`` stays, beside the new one: name another
    then. No rows give no rows.
    """
    names = rows.columns
    inner = rows.toDF(*map(str, range(len(names))))
    schema = StructType([*inner.schema.fields, StructField(str(len(names)), StringType())])
    return inner.mapInArrow(_decode(model, names.index(ids)), schema).toDF(*names, out)
