"""SentencePiece encoding and decoding by a streaming Viterbi pass over a model's pieces."""

from __future__ import annotations

import hashlib
import math
import struct
from collections.abc import Iterable, Iterator
from functools import lru_cache
from itertools import chain

import ahocorasick
import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import chunks

#: The file of the public tokenizers that is used unless another path is given.
DEFAULT_MODEL = "/opt/tokenizers/piece_bpe_32k.model"
#: Words whose ids a task remembers; a word beyond that is encoded each time a chunk holds it.
REMEMBER = 200_000
UNIGRAM, BPE = 1, 2
NORMAL, UNKNOWN, CONTROL, USER, UNUSED, BYTE = 1, 2, 3, 4, 5, 6
MARK = "▁"


def _fields(b: bytes) -> Iterator[tuple[int, int, int | bytes]]:
    """(field, wire type, value) of a protocol buffer message."""
    i = 0

    def varint() -> int:
        nonlocal i
        x = s = 0
        while True:
            c = b[i]
            x |= (c & 127) << s
            i, s = i + 1, s + 7
            if c < 128:
                return x

    while i < len(b):
        key = varint()
        kind = key & 7
        if kind == 0:
            yield key >> 3, kind, varint()
        elif kind == 2:
            n = varint()
            yield key >> 3, kind, b[i : i + n]
            i += n
        else:
            n = 8 if kind == 1 else 4
            yield key >> 3, kind, b[i : i + n]
            i += n


class Model:
    """Pieces, scores and flags of a SentencePiece model file; kind UNIGRAM or BPE."""

    def __init__(self, data: bytes):
        self.pieces: list[str] = []
        self.scores: list[float] = []
        self.types: list[int] = []
        self.kind, self.byte_fallback, self.dummy_prefix, extra_spaces, charsmap = UNIGRAM, False, True, True, b""
        for field, _, value in _fields(data):
            if field == 1:
                piece, score, kind = "", 0.0, NORMAL
                for f, _, v in _fields(value):
                    if f == 1:
                        piece = v.decode()
                    elif f == 2:
                        score = struct.unpack("<f", v)[0]
                    elif f == 3:
                        kind = v
                self.pieces.append(piece)
                self.scores.append(score)
                self.types.append(kind)
            elif field == 2:
                for f, _, v in _fields(value):
                    if f == 3:
                        self.kind = v
                    elif f == 35:
                        self.byte_fallback = bool(v)
            elif field == 3:
                for f, _, v in _fields(value):
                    if f == 2:
                        charsmap = v
                    elif f == 3:
                        self.dummy_prefix = bool(v)
                    elif f == 4:
                        extra_spaces = bool(v)
        if charsmap or extra_spaces:
            raise ValueError("only models with identity normalisation that keep all spaces are supported")
        if USER in self.types:
            raise ValueError("models with user-defined pieces are not supported")
        self.ids = {p: i for i, (p, t) in enumerate(zip(self.pieces, self.types, strict=True)) if t in (NORMAL, USER)}
        self.unknown = self.types.index(UNKNOWN)
        self.bytes = {int(p[3:5], 16): i for i, (p, t) in enumerate(zip(self.pieces, self.types, strict=True)) if t == BYTE}
        self.longest = max(map(len, self.ids))
        self.prefixes: dict[str, int] = {}
        for p in self.ids:
            for k in range(1, len(p)):
                self.prefixes.setdefault(p[:k], 0)
            self.prefixes[p] = 2
        known = [s for s, t in zip(self.scores, self.types, strict=True) if t == NORMAL]
        self.unknown_score = min(known) - 10
        #: no piece goes over from a word into the next: then all paths meet before each mark
        self.splits_at_marks = not any(MARK in p.lstrip(MARK) for p in self.ids)
        if MARK not in self.ids and not self.byte_fallback:
            self.splits_at_marks = False  # a run of unknown characters, one id, may go over a mark
        self.texts = [p.replace(MARK, " ") for p in self.pieces]
        self.byte_of = {i: x for x, i in self.bytes.items()}
        self.special = {i for i, t in enumerate(self.types) if t in (CONTROL, BYTE, UNKNOWN)}
        self._fits: dict[tuple[str, str], bool] = {}
        self._whole: dict[str, bool] = {}
        self._edges: tuple[dict, dict] = ({}, {})
        self._finder = None
        self.memory: dict[str, tuple[int, ...]] = {}
        self.most_open = 0  # most units held back at once, for tests

    # ---- what may follow what --------------------------------------------------------------------

    def merged(self, text: str, upto: int = 1) -> list[str]:
        """Merge order on a short text, as long as more than `upto` parts are left: the best-scored neighbouring pair
        first, leftmost of equals."""
        parts = list(text)
        while len(parts) > upto:
            best, at = None, -1
            for i in range(len(parts) - 1):
                n = self.ids.get(parts[i] + parts[i + 1])
                if n is not None and (best is None or self.scores[n] > best):
                    best, at = self.scores[n], i
            if best is None:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return parts

    def whole(self, piece: str) -> bool:
        ok = self._whole.get(piece)
        if ok is None:
            ok = self._whole[piece] = len(piece) == 1 or self.merged(piece) == [piece]
        return ok

    def edge(self, piece: str, side: int) -> list[tuple[str, float, float]]:
        """The parts that stand at the piece's right (side 1) or left (0) end while it is merged together:
        (part, time from which it stands, time at which it goes into a larger one)."""
        found = self._edges[side].get(piece)
        if found is None:
            if len(piece) == 1:
                found = [(piece, -math.inf, math.inf)]
            else:
                parts = self.merged(piece, 2)
                at = -self.scores[self.ids[piece]]
                inner = self.edge(parts[side], side)
                found = [*inner[:-1], (inner[-1][0], inner[-1][1], at), (piece, at, math.inf)]
            self._edges[side][piece] = found
        return found

    def fits(self, a: str, b: str) -> bool:
        """Whether b may follow a: merging their text gives back a and b, for no merge across the boundary comes in
        time. A merge-order segmentation is the one whose neighbours all fit, so it is a path problem."""
        ok = self._fits.get((a, b))
        if ok is None:
            if len(self._fits) > 400_000:
                self._fits.clear()
            left, right, ok = self.edge(a, 1), self.edge(b, 0), True
            i = j = 0
            while True:
                x, x_from, x_to = left[i]
                y, y_from, y_to = right[j]
                n = self.ids.get(x + y)
                if n is not None:
                    at = max(-self.scores[n], x_from, y_from)
                    # of equal merges the leftmost comes first: a's own before it, b's own after it
                    if at < x_to and (at < y_to or at == y_to == -self.scores[n]):
                        ok = False
                        break
                if x_to == y_to == math.inf:
                    break
                if x_to <= y_to:
                    i += 1
                else:
                    j += 1
            self._fits[a, b] = ok
        return ok

    # ---- Viterbi ---------------------------------------------------------------------------------

    def stream(self, parts: Iterable[str]) -> Iterator[str]:
        """Pieces of a text that comes in parts, by Viterbi over the places where pieces end. A piece begins at most
        `longest` characters before it ends, so only the last `longest` places can still get successors; as soon as the
        backpointers of all of them pass one boundary, the pieces before it are given out and their places forgotten.

        Unigram models take the best sum of scores, the longer piece of equals. In a merge-order model exactly one piece
        fits at each place, so the first that fits is taken. A character in no piece is a piece of its own."""
        bpe, scores, ids, fits, slow, longest = self.kind == BPE, self.scores, self.ids, self._fits.get, self.fits, self.longest
        last: list[str | None] = [""]  # the last piece of the best path to each place of the window
        score = [0.0]
        base = seen = done = 0  # place of index 0; characters before this part; places with their piece, by index
        check = 2 * longest
        search = None
        for part in parts:
            if search is None:
                search = self.finder().iter(part)
            else:
                search.set(part)
            last += [None] * len(part)
            if not bpe:
                score += [-math.inf] * len(part)
            ends = chain(search, ((seen + len(part), None),))  # the end of the part settles what is left
            for end, found in ends:
                to = end + 1 - base
                while done < to - 1:
                    done += 1
                    if bpe:
                        if last[done] is None:
                            last[done] = part[base + done - seen - 1]
                    elif (c := part[base + done - seen - 1]) not in ids and score[done - 1] + self.unknown_score > score[done]:
                        last[done], score[done] = c, score[done - 1] + self.unknown_score
                    if done >= check:
                        self.most_open = max(self.most_open, done)
                        cut = self._boundary(last, done)
                        yield from _path(last, cut)
                        del last[:cut]
                        if not bpe:
                            del score[:cut]
                            score = [x - score[0] for x in score]
                        last[0] = ""
                        base, done, to = base + cut, done - cut, to - cut
                        check = max(2 * longest, done + longest)
                if found is None:
                    break
                size, piece = found
                prev = last[to - size]
                if bpe:
                    if last[to] is None:
                        ok = not prev or fits((prev, piece))
                        if ok or ok is None and slow(prev, piece):
                            last[to] = piece
                elif (s := score[to - size] + scores[ids[piece]]) > score[to]:
                    last[to], score[to] = piece, s
            seen += len(part)
        yield from _path(last, len(last) - 1)

    def _boundary(self, last: list[str], done: int) -> int:
        """A boundary that the best paths to all open places share: the start of the last piece they all go through,
        for that piece's successor must still fit it."""
        low = done
        for k in range(max(0, done - self.longest + 1), done):
            while k != low:  # the later of two places goes back until they meet
                if k > low:
                    k -= len(last[k])
                else:
                    low -= len(last[low])
        return low - len(last[low]) if low > 0 else 0

    def finder(self) -> ahocorasick.Automaton:
        """The pieces by the places where they end; of a merge-order model, those that merging their own text gives back."""
        if self._finder is None:
            self._finder = ahocorasick.Automaton()
            for p in self.ids:
                if self.kind != BPE or self.whole(p):
                    self._finder.add_word(p, (len(p), p))
            self._finder.make_automaton()
        return self._finder

    def normal(self, text: str) -> str:
        return (MARK if self.dummy_prefix and text else "") + text.replace(" ", MARK)

    def _ids(self, pieces: Iterator[str]) -> Iterator[int]:
        """Ids of pieces; unknown characters as bytes, or a run of them as one unknown id."""
        run = False
        for p in pieces:
            n = self.ids.get(p)
            if n is not None:
                yield n
            elif self.byte_fallback:
                yield from (self.bytes[x] for x in p.encode("utf-8", "surrogatepass"))
            elif not run:
                yield self.unknown
            run = n is None

    def word(self, unit: str) -> tuple[int, ...]:
        found = self.memory.get(unit)
        if found is None:
            found = tuple(self._ids(self.stream((unit,))))
            if len(self.memory) < REMEMBER and len(unit) <= 64:
                self.memory[unit] = found
        return found

    def encode(self, text: str) -> np.ndarray:
        units: list[str]
        norm = self.normal(text)
        if not norm:
            return np.zeros(0, dtype=np.int32)
        if not self.splits_at_marks:
            return np.fromiter(self._ids(self.stream((norm,))), dtype=np.int32)
        units = norm.split(MARK)
        first = units[0]
        if "" in units[1:]:  # neighbouring spaces: their marks belong to one stretch
            units, held = [], ""
            for c in norm.split(MARK)[1:]:
                held += MARK
                if c:
                    units.append(held + c)
                    held = ""
            if held:
                units.append(held)
        else:
            units = [MARK + u for u in units[1:]]
        if first:
            units.insert(0, first)
        get, word = self.memory.get, self.word
        return np.fromiter(chain.from_iterable([get(u) or word(u) for u in units]), dtype=np.int32)

    def encode_all(self, texts: pa.Array) -> list[np.ndarray | None]:
        """encode() of each text, None for null: the distinct words of the texts are looked up once, and their ids dealt
        out to the places of the words."""
        if not (self.splits_at_marks and self.dummy_prefix):
            return [None if t is None else self.encode(t) for t in texts.to_pylist()]
        split = pc.split_pattern(texts, " ")
        words = split.flatten().dictionary_encode()
        sizes = pc.fill_null(pc.list_value_length(split), 0).to_numpy().astype(np.int64)
        codes = words.indices.to_numpy()
        units = words.dictionary.to_pylist()
        get, word = self.memory.get, self.word
        ids = [(get(u) or word(u)) if u else () for u in map(MARK.__add__, units)]
        lens = np.fromiter(map(len, ids), np.int64, len(ids))
        flat = np.fromiter(chain.from_iterable(ids), np.int32, int(lens.sum()))
        n = lens[codes]
        ends = np.cumsum(n)
        out = flat[np.repeat((np.cumsum(lens) - lens)[codes] - (ends - n), n) + np.arange(int(ends[-1]) if len(ends) else 0)]
        upto = np.concatenate([[0], ends])[np.concatenate([[0], np.cumsum(sizes)])]
        # neighbouring, leading and last spaces, and marks in the text itself, join into stretches: those go one by one
        empty = np.concatenate([[0], np.cumsum(np.fromiter(map(len, units), np.int64, len(units))[codes] == 0)])[np.concatenate([[0], np.cumsum(sizes)])]
        alone = (np.diff(empty) > 0) | pc.fill_null(pc.match_substring(texts, MARK), False).to_numpy(zero_copy_only=False)
        null = texts.is_null().to_numpy(zero_copy_only=False)
        return [None if null[k] else self.encode(texts[k].as_py()) if alone[k] else out[upto[k] : upto[k + 1]] for k in range(len(texts))]

    def decode(self, ids) -> str:
        out: list[str] = []
        ids = ids.tolist() if isinstance(ids, np.ndarray) else list(ids)
        texts = self.texts
        if not self.special.intersection(ids):
            text = "".join([texts[i] for i in ids])
        else:
            raw = bytearray()
            for i in ids:
                if i in self.byte_of:
                    raw.append(self.byte_of[i])
                    continue
                if raw:
                    out.append(raw.decode("utf-8", "replace"))
                    raw = bytearray()
                if i not in self.special:
                    out.append(texts[i])
                elif i == self.unknown:
                    out.append(" ⁇ ")
            if raw:
                out.append(raw.decode("utf-8", "replace"))
            text = "".join(out)
        return text[1:] if self.dummy_prefix and text.startswith(" ") else text


def _path(last: list[str], upto: int) -> list[str]:
    out = []
    while upto > 0:
        out.append(last[upto])
        upto -= len(last[upto])
    return out[::-1]


@lru_cache(maxsize=2)
def load(path_or_data) -> Model:
    if isinstance(path_or_data, bytes):
        return Model(path_or_data)
    with open(path_or_data, "rb") as f:
        return Model(f.read())


def encode_pieces(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", model_path: str = DEFAULT_MODEL) -> DataFrame:
    """One row per row of df, without a shuffle: doc_id, ids array<int>, decoded string.

    Whole texts, in batches of rows; no begin or end marks are added. Null text: null ids and decoded. Empty: no ids.
    A text of any length passes through a window; a run of unknown characters is one unknown id. Models with a
    normalisation table, that drop spaces, or with user-defined pieces are refused with a ValueError. Unigram scores
    are summed in double precision from the last boundary, so of paths that tie (the library's single-precision sums
    may part them by rounding) another one may be taken.
    Other columns are not read. The driver reads the model file (0.5 MB) and sends it along.
    """
    with open(model_path, "rb") as f:
        data = f.read()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = load(data)
        for batch in batches:
            for part in chunks(batch):
                got = model.encode_all(part.column(1))
                back = [None if g is None else model.decode(g) for g in got]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(got, pa.list_(pa.int32())), pa.array(back, pa.string())], names=["doc_id", "ids", "decoded"])
        model.memory.clear()  # the worker goes on to other stages

    return df.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{text_col}`").alias("text")).mapInArrow(run, "doc_id long, ids array<int>, decoded string")


def encode_report(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", model_path: str = DEFAULT_MODEL) -> DataFrame:
    """As encode_pieces, digested where it is made: doc_id, n_ids, ids_sha256 (little-endian int32), decoded_sha256,
    round_trip (the decoded text is the text)."""
    with open(model_path, "rb") as f:
        data = f.read()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = load(data)
        for batch in chain.from_iterable(map(chunks, batches)):
            rows = []
            for t, ids in zip(batch.column(1), model.encode_all(batch.column(1)), strict=True):
                if ids is None:
                    rows.append((0, None, None, None))
                    continue
                t = t.as_py()
                back = model.decode(ids)
                rows.append((len(ids), hashlib.sha256(ids.astype("<i4").tobytes()).hexdigest(), hashlib.sha256(back.encode()).hexdigest(), back == t))
            cols = list(zip(*rows, strict=True)) or [[]] * 4
            yield pa.RecordBatch.from_arrays([batch.column(0), *[pa.array(c, k) for c, k in zip(cols, (pa.int64(), pa.string(), pa.string(), pa.bool_()), strict=True)]], names=["doc_id", "n_ids", "ids_sha256", "decoded_sha256", "round_trip"])
        model.memory.clear()

    return df.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{text_col}`").alias("text")).mapInArrow(run, "doc_id long, n_ids long, ids_sha256 string, decoded_sha256 string, round_trip boolean")
